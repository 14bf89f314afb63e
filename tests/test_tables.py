from __future__ import annotations

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from attestra.operators import merges, metrics, sampling
from attestra.plans import tables
from attestra.sources import files, manifests, sinks
from attestra.streaming import jobs


def test_csv_and_json_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿filename,product_type,brand_name,imported,panel_filenames\na.png, wine ,X,yes,a.png|b.png\nb.png,wine,,no,\nc.png,wine,Z,perhaps,\n", encoding="utf-8")
    got = manifests.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("row").collect()
    assert [r.row for r in got] == [2, 3, 4] and got[0].files == ["a.png", "b.png"] and got[0].imported is True and got[0].error is None and got[0].product_type == "wine"
    assert "missing brand_name" in got[1].error and got[1].files == ["b.png"] and "imported" in got[2].error
    (tmp_path / "m.json").write_text(json.dumps({"items": [{"filename": "a.png", "product_type": "wine", "brand_name": "X", "panel_filenames": ["p", " "]}]}))
    one = manifests.read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (one.row, one.files, one.country_of_origin, one.class_type) == (1, ["p"], None, "")
    with pytest.raises(ValueError, match="brand_name"):
        manifests.items(spark.createDataFrame([("a", "b", 1)], "filename string, product_type string, _row int"), "_row")
    with pytest.raises(ValueError):
        manifests.read_manifest(spark, "m.xlsx")


def test_registry_and_ids(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿TTB ID,Permit No.,Completed Date,Brand Name\n'25337001000464',BW-I-1,01/02/2025,\"A, B\"\n,x,y,z\n", encoding="utf-8")
    rows = manifests.read_registry(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.ttb_id, r.permit_no, r.brand_name) for r in rows] == [("25337001000464", "BW-I-1", "A, B")]
    (tmp_path / "ids.txt").write_text("'1'\n2\n2\n\n")
    assert sorted(r.id for r in manifests.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["1", "2"]


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "a,b\n1,2\n")
        z.writestr("y.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"nope")
    got = files.archive_members(spark, str(tmp_path / "*.zip")).collect()
    assert sorted((r.name or "", r.problem or "") for r in got) == [("", "not a zip file"), ("d/x.csv", "")]
    (tmp_path / "p.html").write_bytes('<meta charset="iso-8859-1">café'.encode("latin-1"))
    assert files.pages(spark, str(tmp_path / "p.html")).first().html.endswith("café")
    names = spark.createDataFrame([("a.png",), ("a.exe",), ("../a.png",), ("d/a.png",), ("a.exe.png",), ("",)], "n string")
    assert [r.p for r in names.select(files.upload_name_problem(F.col("n")).alias("p")).collect()] == [None, "suffix", "traversal", "separator", "double extension", "empty"]
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (tmp_path / "i/b.jpg").write_bytes(b"<!DOCTYPE html>")
    (tmp_path / "i/c.txt").write_bytes(b"x")
    found = files.images(spark, str(tmp_path / "i")).select(files.image_problem(F.col("path"), F.col("content")).alias("p")).collect()
    assert sorted(r.p or "" for r in found) == ["", "html"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a  b", None, "train"), (2, "c", "d", "dev")], "id int, t string, u string, split string")
    sinks.write_splits(df, str(tmp_path / "s"), ["id", "t", "u"])
    assert {(r.id, r.t, r.split) for r in spark.read.json(str(tmp_path / "s/jsonl")).collect()} == {(1, "a b", "train"), (2, "c", "dev")}
    assert sinks.shaped(df, ["id", "nothing", "u"]).first().asDict() == {"id": "1", "nothing": "", "u": ""}
    sinks.append_checkpoint(df, str(tmp_path / "c"))
    sinks.append_checkpoint(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4


def test_allocation(spark):
    strata = spark.createDataFrame([("a", 10), ("b", 5), ("c", 1), ("d", 0)], "k string, n bigint")
    got = {r.k: r.quota for r in sampling.allocated(strata, "k", "n", 8).collect()}
    assert got == {"a": 5, "b": 3, "c": 0, "d": 0}
    floors = {r.k: r.quota for r in sampling.allocated(strata, "k", "n", 2, floor=3).collect()}
    assert floors == {"a": 3, "b": 3, "c": 1, "d": 0}


def test_samples_are_exact_and_disjoint(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    cut = sampling.exact_cut(df, "s", ["id"], 100, "x", "y")
    assert {r.split: r["count"] for r in cut.groupBy("split").count().collect()} == {"x": 100, "y": 900}
    parts = sampling.split_by_ratio(df, ["g"], "s", ["id"], {"a": 0.6, "b": 0.2, "c": 0.2})
    again = sampling.split_by_ratio(df.repartition(13), ["g"], "s", ["id"], {"a": 0.6, "b": 0.2, "c": 0.2})
    assert parts.exceptAll(again).isEmpty()
    assert sorted(r.fetch_order for r in sampling.fetch_order(df, "s", ["id"]).collect()) == list(range(1, 1001))
    turns = sampling.round_robin(df, ["g"], "s", ["id"], 14).groupBy("g").count().collect()
    assert all(r["count"] == 2 for r in turns) and len(turns) == 7
    pairs = sampling.negative_pairs(df.withColumn("v", F.col("id") % 3), ["g"], "id", "v", "s", 2).collect()
    assert len(pairs) == 2000 and all(p.id != p.candidate_id and p.v != p.candidate_v for p in pairs)
    days = spark.createDataFrame([(datetime.date(2025, 5, 1), datetime.date(2025, 7, 31))], "a date, b date")
    plan = sampling.sampled_days(sampling.business_days(days, "a", "b"), "s", 3).collect()
    assert len(plan) == 9 and sum(p.role == "primary" for p in plan) == 6 and all(p.day.weekday() < 5 for p in plan)


def test_whole_texts_are_normalised(spark, tmp_path):
    text = "Ab-c  d " * 100
    spark.createDataFrame([(1, text + "one"), (2, text + "two")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in tables.normalised_text(spark, str(tmp_path)).collect()}
    assert got[1].plain == "ab c d " * 100 + "one" and got[2].flat == "Ab-c d " * 100 + "two"


def test_confusion_counts_every_source(spark, tmp_path):
    docs = [(i, "t", "en", f"src{i % 3}", 4000) for i in range(9)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r.source: r.examples for r in tables.confusion_by_source(spark, str(tmp_path)).collect()} == {"src0": 3, "src1": 3, "src2": 3}


def test_negative_pairs_are_found_at_any_distance(spark):
    rows = [("a", i, 0) for i in range(200)] + [("a", 200, 1), ("a", 201, 2)] + [("b", 1, i) for i in range(30)] + [("b", 2, 50), ("c", 1, 1), ("c", 2, 1)]
    got = sampling.negative_pairs(spark.createDataFrame(rows, "g string, id int, v int"), ["g"], "id", "v", "s", 2).collect()
    want = sum(min(2, sum(h == g and j != i and w != v for h, j, w in rows)) for g, i, v in rows)
    assert len(got) == want and all(p.id != p.candidate_id and p.v != p.candidate_v for p in got)
    assert len({(p.g, p.id, p.v, p.negative) for p in got}) == want


def test_metrics_of_nothing_and_ties(spark):
    none = spark.createDataFrame([], "y int, p boolean")
    r = metrics.confusion(none, "y", "p").first()
    assert (r.examples, r.accuracy, r.f1, r.false_clear_rate) == (0, 0.0, 0.0, 0.0)
    e = spark.createDataFrame([({"b": 90.0, "a": 90.0, "c": 10.0}, "alcohol_content"), ({}, "brand_name")], "s map<string,double>, f string")
    said = e.select(*[c.alias(n) for n, c in metrics.votes(F.col("s"), F.col("f"), 60.0, 80.0).items()], metrics.best_engine(F.col("s")).alias("best")).collect()
    assert said[0].best == "a" and said[0].majority and not said[0].unanimous and not said[0].government_safe and not said[1].any


def test_merges(spark):
    table = spark.createDataFrame([(1, "old", "p"), (2, "old", "q")], "k int, a string, path string")
    delta = spark.createDataFrame([(1, "x", None, 1), (1, "y", None, 2), (3, "n", None, 1)], "k int, a string, path string, seq int")
    assert {(r.k, r.a) for r in merges.upserted(table, delta, ["k"], "seq").collect()} == {(1, "y"), (2, "old"), (3, "n")}
    assert merges.replaced(table, delta.limit(0).drop("seq"), ["k"]).count() == 2
    marked = merges.marked_pending(table.withColumn("status", F.lit(200)), F.col("k") == 1, "path", "status").orderBy("k").collect()
    assert (marked[0].path, marked[0].status, marked[1].status) == (None, 0, 200)


EVENTS = [("j1", 1, "enqueue"), ("j1", 2, "claim"), ("j1", 3, "cancel"), ("j1", 4, "fail"), ("j2", 1, "claim"), ("j2", 2, "enqueue"), ("j3", 1, "enqueue"), ("j3", 2, "claim"), ("j3", 3, "recover"), ("j3", 4, "claim"), ("j3", 5, "finish")]


def test_job_states_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "job_id string, seq int, event string")
    want = {"j1": "cancelled", "j2": "queued", "j3": "completed"}
    assert {r.job_id: r.state for r in merges.job_states(df, "job_id", "seq", "event").collect()} == want
    for part in (1, 2):
        df.where((F.col("seq") <= 2) if part == 1 else (F.col("seq") > 2)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = jobs.job_states(stream).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    final = {}
    for r in spark.table("states").collect():
        if r.events >= final.get(r.job_id, (None, 0))[1]:
            final[r.job_id] = (r.state, r.events)
    assert {k: v for k, (v, _) in final.items()} == want


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h % 5, 7 * h % 60), "ab"[h % 2], float(h)) for h in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string, value double")
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in jobs.windowed_counts(df, "ts", ["kind"], "1 hour", "1 day").collect()}
    stream = jobs.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["kind"], "1 hour", "1 day")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("hours").collect()} == batch


def test_panels(spark):
    df = spark.createDataFrame([("i", 2, "b.png", "B", 0.5, 10, "x"), ("i", 1, "a.png", "A", 1.0, 5, "y")], "item string, panel int, filename string, full_text string, avg_confidence double, total_ms int, source string")
    r = manifests.combined_panels(df, "item", "panel").first()
    assert (r.full_text, r.avg_confidence, r.total_ms, r.source, r.panels) == ("[Panel 1: a.png]\nA\n\n[Panel 2: b.png]\nB", 0.75, 15, "x + y", 2)


def test_best_by_words_in_blocks(spark):
    import random

    from attestra.operators import evaluation

    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, r.sample(words, r.randint(0, 12))) for i in range(60)]
    asked = [(i, r.sample(words, r.randint(1, 6))) for i in range(15)] + [(99, []), (98, ["unseen"]), (97, ["unseen", "w1", "w1"])]
    d, p = spark.createDataFrame(docs, "doc long, have array<string>").repartition(4), spark.createDataFrame(asked, "item long, want array<string>")
    want = {i: min((-100 * len(set(w) & set(h)) / len(set(w)), k) for k, h in docs if h) for i, w in asked if w}
    assert want[98] == (0, min(k for k, h in docs if h))
    for block in (10_000, 20, 1):
        got = {x["item"]: (-x["score"], x["doc"]) for x in evaluation.best_by_words(d, p, "doc", "have", "item", "want", block).collect()}
        assert set(got) == set(want) and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-5 for i in want)


def test_best_by_words_works_out_the_words_of_a_document_once(spark):
    from pyspark.sql import functions as F

    from attestra.operators import evaluation

    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(s):
        made.add(1)
        return s.split()

    d = spark.createDataFrame([(i, f"a b{i}" if i % 5 else "") for i in range(40)], "doc long, text string").repartition(3).select("doc", words("text").alias("have"))
    p = spark.createDataFrame([(1, ["b7", "a"]), (2, ["c"])], "item long, want array<string>")
    got = evaluation.best_by_words(d, p, "doc", "have", "item", "want").collect()
    assert sorted(map(tuple, got)) == [(1, 7, 100.0), (2, 1, 0.0)] and made.value == 40


def test_best_by_words_in_small_steps(spark, monkeypatch):
    import random

    from attestra.operators import evaluation

    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i}", [r.choice(words) for _ in range(r.randint(0, 15))] if i % 7 else None) for i in range(80)]
    asked = [(f"p{i}", r.sample(words, r.randint(1, 6)) + ["unseen"] * (i % 2)) for i in range(20)]
    d, p = spark.createDataFrame(docs, "doc string, have array<string>").repartition(3), spark.createDataFrame(asked, "item string, want array<string>")
    want = {i: min((-100 * len(set(w) & set(h)) / len(set(w)), k) for k, h in docs if h) for i, w in asked}
    for meetings in (1, 300, 1 << 21):
        monkeypatch.setattr(evaluation, "MEETINGS", meetings)
        got = {x["item"]: (-x["score"], x["doc"]) for x in evaluation.best_by_words(d, p, "doc", "have", "item", "want").collect()}
        assert set(got) == set(want) and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-5 for i in want)


def test_best_by_words_of_nothing(spark):
    from attestra.operators import evaluation

    none = spark.createDataFrame([], "id long, words array<string>")
    assert evaluation.best_by_words(none.withColumnRenamed("id", "doc"), none, "doc", "words", "id", "words").count() == 0


def test_white_space_by_ranges_is_all_of_it(spark):
    from attestra.functions import text as tx

    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in [*range(1, 0x3100), 0xFEFF]], "c int, s string")
    got = {r.c for r in df.select("c", tx.collapsed(df.s).alias("t")).where("t = 'a b'").collect()}
    assert got == {ord(c) for c in tx.WHITE}


def test_folding_takes_private_signs_for_nothing(spark):
    from attestra.functions import text as tx

    df = spark.createDataFrame([("\ue001 Été Ａ1\ue030É \uf8ff²",)], "s string")
    assert df.select(tx.label_text(df.s)).first()[0] == "e te a1 e 2"


def test_contact_sheet_tops_up(spark):
    from attestra.operators import records

    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id long, kind string")
    got = records.contact_sheet(df, "kind", "s", ["id"], 5, 30).collect()
    assert len(got) == 30 and sum(r.kind == "b" for r in got) >= 5 and len({r.id for r in got}) == 30
    assert records.contact_sheet(df, "kind", "s", ["id"], 5, 7).count() == 7


def test_latency_of_ties_and_nulls(spark):
    from attestra.operators import metrics

    df = spark.createDataFrame([("a", v) for v in [5, 5, 5, 7, None, 100]] + [("b", 1)], "engine string, ms long")
    got = {r.engine: r for r in metrics.latency(df, "ms", ["engine"]).collect()}
    assert (got["a"].n, got["a"]["mean"], got["a"].median, got["a"].most, got["a"].p95_floor, got["a"].p95_linear) == (5, 24.4, 5.0, 100, 100, 81.4)
    assert got["b"].p95_round == 1 and got["b"].median == 1.0


def test_attachments_meet_by_parts_not_all_with_all(spark):
    from attestra.operators import records

    names = ["a.png", "b.png", "ab.png", ".png", "x.y.png", "none", "c"]
    others = ["a.png", "b.jpg", "front_b_1.gif", "xab", "", "c.gif", "zz", "cc"]
    images = spark.createDataFrame([(k, n) for k in (1, 2, None) for n in [*names, None]], "k int, name string")
    given = spark.createDataFrame([(k, o, i) for k in (1, 3, None) for i, o in enumerate([*others, None])], "k int, other string, turn int")
    stem = lambda s: s.rpartition(".")[0] if "." in s else s
    want = {}
    for n in names:
        hows = [(1 if n == o else 2 if stem(n) == stem(o) else 3, i, o) for i, o in enumerate(others) if n == o or stem(n) == stem(o) or stem(n) in o]
        if hows:
            want[(1, n)] = (min(hows)[2], min(hows)[0])
    found = records.attachment_of(images, given, "k", "name", "other", "turn")
    assert {(r.k, r.name): (r.attachment, r.how) for r in found.collect()} == want
    assert "Contains(" not in found._jdf.queryExecution().optimizedPlan().toString()
