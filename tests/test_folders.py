"""Folders of fixtures, jobs and a corpus; examples and their scores."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from attestra.operators import examples
from attestra.sources import folders


def put(path, payload):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(payload, indent=1))


def test_fixtures(spark, tmp_path):
    put(tmp_path / "a_pass.application.json", {"fixture_id": "other", "brand_name": "B", "imported": True})
    put(tmp_path / "a_pass.ocr_text.json", {"full_text": "T", "avg_confidence": 0.9, "blocks": [{"text": "x", "confidence": 0.5, "bbox": None}], "source": "engine"})
    put(tmp_path / "a_pass.expected.json", {"overall_verdict": "pass", "checked_rule_ids": ["R"]})
    put(tmp_path / "b.application.json", {"brand_name": "C"})
    got = {r.fixture_id: r for r in folders.read_fixtures(spark, str(tmp_path)).collect()}
    a = got["a_pass"]
    assert set(got) == {"a_pass", "b"} and (a.application.brand_name, a.ocr.full_text, a.ocr.source, a.expected.checked_rule_ids) == ("B", "T", "fixture ground truth", ["R"])
    assert got["b"].ocr is None and got["b"].expected is None and got["b"].application.imported is None


def test_jobs(spark, tmp_path):
    put(tmp_path / "job 1/manifest.json", {"job_id": "x", "items": [{"item_id": "i2"}, {"item_id": "i1"}]})
    put(tmp_path / "job 1/results/i2.json", {"item_id": "i2", "overall_verdict": "fail"})
    put(tmp_path / "job 1/results/i1.json", {"item_id": "i1", "overall_verdict": "pass"})
    put(tmp_path / "j2/manifest.json", {"items": []})
    got = {r.job_id: r for r in folders.read_jobs(spark, str(tmp_path)).collect()}
    assert set(got) == {"job 1", "j2"} and [r.item_id for r in got["job 1"].results] == ["i1", "i2"] and len(got["job 1"]["items"]) == 2
    assert got["j2"].results == [] and got["j2"].changed is not None


def test_corpus(spark, tmp_path):
    put(tmp_path / "l.json", {"version": 1, "sources": [{"source_id": "s1"}]})
    put(tmp_path / "c.json", {"criteria": [
        {"rule_id": "R1", "source_refs": ["s1", "s9"], "confidence_tier": "tier_2_x", "default_verdict": "fail", "fixtures": ["f"]}, {"rule_id": "R2", "default_verdict": "info"},
        {"rule_id": "R3", "source_refs": [], "confidence_tier": "tier_1", "default_verdict": "maybe"}, {"rule_id": "R4", "default_verdict": "pass", "fixtures": []},
    ]})
    put(tmp_path / "f.json", {"fixtures": [{"fixture_id": "f", "rule_ids": ["R1", "R9"], "source_refs": ["s8"]}, {"fixture_id": "g"}]})
    tables = folders.read_corpus(spark, *[str(tmp_path / f"{n}.json") for n in "lcf"])
    assert sorted((r.item, r.error) for r in folders.corpus_errors(*tables).collect()) == [
        ("R1", "Tier 2/3 rule must not default to Fail"), ("R1", "missing source_ref s9"), ("R3", "invalid default_verdict maybe"), ("R3", "non-info rule has no fixtures"),
        ("R4", "non-info rule has no fixtures"), ("f", "references missing rule_id R9"), ("f", "references missing source_ref s8"),
    ]


def test_examples(spark):
    rows = [("s", i, v) for i, v in enumerate(["red oak", "red oak", "blue", "green", None])] + [("t", 9, "lone")]
    df = spark.createDataFrame(rows, "split string, id long, brand string")
    got = examples.labelled(df, ["split"], "id", "brand", "x", 2)
    found = got.collect()
    assert sorted((r.id, r.candidate) for r in found if r.label == 1) == [(0, "red oak"), (1, "red oak"), (2, "blue"), (3, "green"), (9, "lone")]
    assert all(r.source != r.id and r.candidate != r.expected and r.strategy for r in found if r.label == 0) and len({r.pair_id for r in found}) == len(found)
    assert {i: sum(r.id == i and r.label == 0 for r in found) for i in (0, 1, 2, 9)} == {0: 2, 1: 2, 2: 2, 9: 0}
    texts = spark.createDataFrame([("a", i, "the RED oak 1") for i in (0, 1, 2)] + [("b", 0, "oak"), ("b", 0, "red"), ("b", 1, ""), ("b", 3, "green")], "engine string, id long, body string")
    scored = examples.engine_scores(got, texts, "engine", "id", "body")
    own = {r.id: r.scores for r in scored.where("label = 1").collect()}
    assert own == {0: {"a": 100.0, "b": 50.0}, 1: {"a": 100.0, "b": 0.0}}
    decided = {(r.id, r.strategy_name): (r.predicted, r.outcome, r.supporting_engines) for r in examples.decided(scored.where("label = 1"), F.lit("brand_name"), 90, 95).collect()}
    assert decided[0, "any"] == (1, "true_positive", "a") and decided[0, "unanimous"] == (0, "false_negative", "a")
