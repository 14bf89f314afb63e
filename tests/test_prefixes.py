"""Early stops, numbering by ranges, counted skips, whole families and mapped records against plain Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions.text import order_hash
from attestra.operators import mapping, prefixes, sampling


def loop(rows, limit, reason):
    kept, counts = [], {}
    for r in rows:
        if len(kept) >= limit:
            break
        why = reason(r)
        counts[why] = counts.get(why, 0) + 1
        if why == "kept":
            kept.append(r)
    return kept, counts


@pytest.mark.parametrize("limit", [0, 1, 7, 40, 1000])
def test_kept_until_enough(spark, limit):
    r = random.Random(5)
    rows = [(r.choice([None, "a", "b", "c", "d"]), i, r.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id int, v int").repartition(4)
    kept, counts = prefixes.kept_until_enough(df, ["k", "id"], limit, ranges=8, low=F.col("v") == 0, odd=F.col("v") % 2 == 1)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    want = loop(order, limit, lambda x: "low" if x[2] == 0 else "odd" if x[2] % 2 else "kept")
    assert sorted(map(tuple, kept.collect()), key=lambda x: x[1]) == sorted(want[0], key=lambda x: x[1])
    assert {x.reason: x.n for x in counts.collect()} == want[1]


def test_kept_until_enough_of_nothing(spark):
    none = spark.createDataFrame([], "id int, v int")
    kept, counts = prefixes.kept_until_enough(none, ["id"], 5, bad=F.col("v") == 1)
    assert kept.count() == 0 and counts.count() == 0


def test_stop_reaches_the_scan(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") % 3).write.parquet(str(tmp_path / "t"))
    kept, _ = prefixes.kept_until_enough(spark.read.parquet(str(tmp_path / "t")), ["id"], 10, bad=F.col("v") == 1)
    assert kept.count() == 10 and "LessThanOrEqual(id,14)" in kept._jdf.queryExecution().toString().replace(" ", "")


def test_numbered(spark):
    r = random.Random(6)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, 1.5, 2.5, float("nan")]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, id int").repartition(5)
    got = {x.id: (x.n, x.n_of) for x in prefixes.numbered(df, ["g"], ["x", "id"], "n", ranges=6).collect()}
    for g in ("hot", "a", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] != x[1], x[1] if x[1] == x[1] and x[1] is not None else 0, x[2]))
        assert [got[x[2]] for x in own] == [(i + 1, len(own)) for i in range(len(own))]
    marked = df.withColumn("m", order_hash("s", F.col("id")))
    nums = prefixes.numbered(marked, [], ["m", "id"], "n", prefixes.hash_range(F.col("m"), 64)).orderBy("m").collect()
    assert [x.n for x in nums] == list(range(1, 301)) and prefixes.numbered(df.limit(0), ["g"], ["id"], "n").count() == 0


def test_skips_are_counted_on_the_way(spark):
    df = spark.createDataFrame([(1, "01/02/2024"), (2, "13/45/2024"), (3, None), (4, "02/03/2024"), (1, "bad")], "id int, day string")
    kept, seen = prefixes.counting_skipped(df, "skipped", excluded=F.col("id") == 1, invalid=F.try_to_date("day", "MM/dd/yyyy").isNull())
    assert [r.id for r in kept.collect()] == [4] and seen.get == {"excluded": 2, "invalid": 2, "kept": 1}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 20])
def test_families_stay_whole(spark, n):
    rows = [(f"f{i % n}", "bold" if i // n == 0 else "regular", i) for i in range(3 * n)] + [("lone", "bold", 999)]
    df = spark.createDataFrame(rows, "family string, weight string, id int")
    got = [(r.family, r.split) for r in sampling.split_families(df, "family", F.col("weight") == "bold", F.col("weight").isin("regular", "borderline"), "s").collect()]
    families = {s: {f for f, t in got if t == s} for s in ("train", "validation", "test")}
    usable = n if n >= 6 else n + 1  # with few families the one without a regular font counts too
    train, upto = max(1, int(usable * 0.7)), max(max(1, int(usable * 0.7)) + 1, int(usable * 0.85))
    sizes = (train, min(upto, usable) - train, max(0, usable - upto))
    if sizes[2] == 0:
        sizes = (train, max(1, sizes[1] - 1) if sizes[1] else 1, 1 if sizes[1] else 0)
    assert tuple(len(families[s]) for s in ("train", "validation", "test")) == sizes
    if usable > 3:
        assert not families["train"] & families["validation"] and not families["test"] & (families["train"] | families["validation"])
    assert ("lone" in {f for f, _ in got}) == (n < 6) and len(got) >= 3 * n


@pytest.mark.parametrize("sizes,target", [({"a": 3, "b": 3, "c": 3}, 4), ({"a": 1, "b": 10}, 11), ({"a": 2, None: 5, "unknown": 1}, 5), ({"a": 7}, 0)])
def test_exact_shares(spark, sizes, target):
    got = {r.k: r.quota for r in sampling.allocated_exactly(spark.createDataFrame(list(sizes.items()), "k string, n long"), "k", "n", target).collect()}
    want: dict = {}
    for k, n in sizes.items():
        want[k or "unknown"] = want.get(k or "unknown", 0) + n
    assert sum(got.values()) == target and all(0 <= got[k] <= n for k, n in want.items()) and all(got[k] >= int(target * n / sum(want.values())) for k, n in want.items())
    with pytest.raises(ValueError):
        sampling.allocated_exactly(spark.createDataFrame([("a", 1)], "k string, n long"), "k", "n", 2)


# ---- mapping


def test_spellings():
    assert mapping.spellings("brand_name") == ["brand_name", "BRAND_NAME", "brandName"] and mapping.spellings("K") == ["K", "k"]


def test_mapped_fields(spark):
    rows = [
        (1, json.dumps({"PRODUCT_NAME": None, "productName": "", "FANCIFUL_NAME": "Old", "fanciful_name": None})), (2, json.dumps({"product_name": "New", "FANCIFUL_NAME": "Old"})), (3, "{"), (4, None), (5, "[1]"),
        (6, json.dumps({"productName": 7, "x": {"product_name": "inner"}})), (7, json.dumps({"product_name": True})),
    ]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r.id: r.name for r in mapping.mapped(df, "j", {"name": ["product_name", "fanciful_name"]}).collect()}
    assert got == {1: "Old", 2: "New", 3: "", 4: "", 5: "", 6: "7", 7: "true"}


def test_parsed_records(spark):
    given = {"ttb_id": " 26023001000815 ", "brand_name": "Example  Brand", "product_name": "Example Lager", "product_type": "Malt Beverage", "class_name": "MALT", "domestic_or_imported": "Domestic", "origin_name": "KENTUCKY", "abv": 4.2, "volume": 12.0, "volume_unit": "fluid ounces"}
    rows = [(1, json.dumps(given)), (2, json.dumps({"TTB_ID": "26112001000564", "ABV": 50.0, "volume": "750.0", "volumeUnit": "milliliters", "origin_name": "France"})), (3, None)]
    got = {r.id: r for r in mapping.parsed_records(spark.createDataFrame(rows, "id int, j string"), "j").collect()}
    a = got[1].application
    assert (got[1].ttb_id, a.brand_name, a.fanciful_name, a.product_type, a.alcohol_content, a.net_contents, a.imported, a.country_of_origin) == ("26023001000815", "Example Brand", "Example Lager", "malt_beverage", "4.2% ALC/VOL", "12 fl oz", False, None)
    assert got[1].form_fields.alcohol_content == "4.2% ALC/VOL" and got[1].form_fields.net_contents == "12 fl oz" and a.filename == "26023001000815.json"
    b = got[2].application
    assert (b.alcohol_content, b.net_contents, b.imported, b.country_of_origin, b.brand_name) == ("50% ALC/VOL", "750 mL", True, "France", "")
    assert got[3].ttb_id == "" and got[3].application.imported is False


def test_arrays_of_records(spark):
    df = spark.createDataFrame([('{"Images": 1, "IMAGES": [{"imageType": "Front"}, {"image_type": ""}]}',), ("{}",)], "j string").withColumn("r", F.try_parse_json("j"))
    got = df.select(F.transform(mapping.elements(F.col("r"), "images"), lambda v: mapping.field(v, "image_type")).alias("t")).collect()
    assert [r.t for r in got] == [["Front", ""], []]
