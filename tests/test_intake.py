from __future__ import annotations

from pyspark.sql import functions as F

import pytest

from attestra.functions import intake, variants
from attestra.operators import evaluation
from attestra.plans import tables

SCHEMA = "id int, full_text string, blocks array<struct<text:string,confidence:double,bbox:array<array<double>>>>"


def block(text, x, y):
    return (text, 0.9, [[x, y], [x + 0.1, y + 0.02]])


def test_lines(spark):
    rows = [
        (1, "x", [block("WORLD", 0.5, 0.101), block("HELLO", 0.1, 0.1), block(" ", 0.2, 0.1), block("below", 0.1, 0.2)]),
        (2, "a\n\n b  c \n", None),
        (3, "x", [("no", 0.9, None), ("box", 0.9, [[0.1, 0.1]])]),
        (4, None, []),
    ]
    got = {r.id: r.lines for r in intake.with_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ["HELLO WORLD", "below"], 2: ["a", "b c"], 3: ["no", "box"], 4: []}


def test_candidates(spark):
    body = "GOVERNMENT WARNING: x\n750 mL\nOLD TOM\nKentucky Bourbon\n45.5% ALC/VOL 91 proof\nProduct of New Zealand"
    df = spark.createDataFrame([(1, body), (2, ""), (3, "90 proof"), (4, "40%x")], "id int, t string")
    c = intake.candidates(intake.lines_of(F.col("t")), F.col("t"))
    got = {r.id: r for r in df.select("id", *[v.alias(k) for k, v in c.items()]).collect()}
    one = got[1]
    assert (one.brand_name.value, one.product_type.value, one.class_type.value) == ("OLD TOM", "distilled_spirits", "Kentucky Bourbon")
    assert (one.alcohol_content.value, one.alcohol_content.confidence, one.net_contents.value, one.country_of_origin.value) == ("45.5% ALC/VOL", 0.82, "750 mL", "New Zealand")
    assert all(v is None for k, v in got[2].asDict().items() if k != "id")
    assert got[3].alcohol_content.value == "90 proof (~45% ALC/VOL)" and got[4].alcohol_content.value == "40%"


def test_variants(spark):
    rows = [("alcohol_content", "45.2"), ("net_contents", "750 MILLILITERS"), ("class_type", "MEZCAL FB"), ("country_of_origin", "France"), ("brand_name", "'123'"), ("brand_name", " ")]
    got = [set(r.v) for r in spark.createDataFrame(rows, "f string, x string").select(variants.field_variants(F.col("f"), F.col("x")).alias("v")).collect()]
    assert "45.2% alc/vol" in got[0] and "750 ml" in got[1] and {"mezcal", "MEZCAL FB"} <= got[2] and "Made in France" in got[3] and got[4] == {"123"} and got[5] == set()


def test_best_panel_and_verdicts(spark):
    apps = spark.createDataFrame([(1, "RIO VISTA", "Mezcal FB"), (2, "NOWHERE", None)], "item int, brand_name string, class_type string")
    panels = spark.createDataFrame([(1, 1, "front rio"), (1, 2, "RIO VISTA mezcal"), (1, 3, "rio vista mezcal"), (2, 1, "zzz")], "item int, panel int, body string")
    found = evaluation.evaluated(evaluation.targets(apps, "item", ["brand_name", "class_type"]), panels, "item", "panel", "body")
    got = {(r.item, r.field): r for r in found.collect()}
    assert (got[1, "brand_name"].best_panel, got[1, "brand_name"].outcome, got[1, "class_type"].best_candidate) == (2, "matched", "mezcal")
    assert (got[2, "brand_name"].best_panel, got[2, "brand_name"].score, got[2, "brand_name"].verdict) == (None, 0.0, "needs_review") and len(got) == 3
    assert {r.item: r.overall_verdict for r in evaluation.application_verdicts(found, "item").collect()} == {1: "pass", 2: "needs_review"}


def test_items_of_one_panel_are_scored_in_their_row(spark):
    fields = ["brand_name", "class_type", "alcohol_content", "country_of_origin"]
    rows = [("RIO  VISTA", "Mezcal FB", "45.2", "France"), ("rio", None, " ", "'12'"), ("CORAZ\u00d3N del rio rio", "Red Wine x", "5% ALC/VOL", "United States"), ("#", "", "x", "")]
    texts = ["RIO VISTA mezcal 45.2% alcohol PRODUCT OF FRANCE", "made in 12 states, red wine 5% alc", "corazo n del", "", None]
    items = spark.createDataFrame([(i * 10 + j, 7, *r, t) for i, r in enumerate(rows) for j, t in enumerate(texts)], "item int, panel int, " + ", ".join(f"{f} string" for f in [*fields, "body"]))
    left = evaluation.evaluated_alone(items, "item", "panel", "body", fields)
    right = evaluation.evaluated(evaluation.targets(items, "item", fields), items, "item", "panel", "body")
    assert left.columns == right.columns and left.count() and left.exceptAll(right).count() == right.exceptAll(left).count() == 0


def _written(spark):
    """Bytes that all stages so far have shuffled."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_field_evaluations_shuffles_keys_not_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    # Some items have two rows: with another supplier, by two parts that make the same id, and by a row that is there twice.
    keys = [(o, (7 * o + n) % 500, n, (o * 3 + n) % 90) for o in range(1, 2000) for n in (1, 2, 3)] + [(5, 36, 1, 77), (3, 10_000_043, 1, 4), (4, 29, 1, 13), (4, 10_000_029, 1, 13)]
    parts = [(p, f"old ring {p % 7}", f"Brand#{p % 9}", ["LARGE", "SMALL PLATED"][p % 2], p % 50 + 1) for p in [*range(500), 10_000_043, 10_000_029]]
    for twice in (False, True):
        folder = str(tmp_path / f"twice_{twice}")
        spark.createDataFrame(keys, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
        spark.createDataFrame(parts + twice * [(29, "other name", "Brand#99", "ECONOMY", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
        con = duckdb.connect()
        for t in ("lineitem", "part"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        before = _written(spark)
        got = tables.field_evaluations(spark, folder).toPandas()
        written = sum(n for s, n in _written(spark).items() if s not in before)
        want = con.sql(tables.ORACLE["field_evaluations"]).df()
        order = ["field", "verdict", "outcome"]
        assert got[want.columns].sort_values(order).values.tolist() == want.sort_values(order).values.tolist()
        assert twice or written < 100 * len(keys), written


def test_windows_and_prompt(spark):
    df = spark.createDataFrame([(["a", " ", "b", "c"],), ([],)], "b array<string>")
    assert [r.w for r in df.select(evaluation.windows(F.col("b")).alias("w")).collect()] == [["a", "b", "c", "a b", "b c", "a b c"], []]
    p = df.limit(1).select(evaluation.prompt(F.lit("net_contents"), F.lit("750 mL"), F.lit("x"), F.lit("wine"), F.lit(None).cast("string"), F.lit(True)).alias("p")).first().p
    assert p.splitlines()[0] == "field: net contents" and p.splitlines()[4:6] == ["origin: ", "imported: true"]


def test_values_alone_equal_those_of_candidates(spark):
    texts = ["OLD OAK 5.5% Alc/Vol 750  mL Product of France", "90 proof 1 pint", "12% wine of new  zealand, Italy", "101.5 PROOF", "nothing", "", None, "NEW ZEALAND 16 FL. OZ."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = intake.candidates(intake.lines_of(F.col("t")), F.col("t"))
    pairs = [(intake.alcohol_value(F.col("t")), c["alcohol_content"]), (intake.contents_value(F.col("t")), c["net_contents"]), (intake.country_value(F.col("t")), c["country_of_origin"])]
    for mine, whole in pairs:
        rows = df.select(mine.alias("a"), whole["value"].alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows] and any(r.a for r in rows)
    plan = df.select(intake.country_value(F.lower(F.regexp_replace("t", "x", "y"))).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("filter(")[1].split("namedlambda")[0].count("regexp_replace") == 0 and plan.count("regexp_replace") == 1
