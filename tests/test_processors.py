"""Streams of jobs: every item once, a cancel between items, restarts; and the worker of queued jobs."""

from __future__ import annotations

import json
import time

import pytest

from attestra.streaming import jobs, processors

SCHEMA = "job_id string, seq int, event string, items array<string>"


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    processors.use_rocksdb(spark)
    (tmp_path / "in").mkdir()

    def send(name, *rows):
        (tmp_path / f"{name}.tmp").write_text("\n".join(json.dumps(dict(zip(("job_id", "seq", "event", "items"), r, strict=True))) for r in rows))
        (tmp_path / f"{name}.tmp").rename(tmp_path / "in" / f"{name}.json")

    def start(seen, wait_ms=1):
        out = processors.processed(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), wait_ms)
        return out.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()

    yield send, start
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def until(query, done, most=90):
    end = time.time() + most
    while not done():
        assert query.isActive and time.time() < end, query.exception()
        time.sleep(0.2)


def test_jobs_take_items_one_by_one(stream):
    send, start = stream
    seen: list = []
    send("a", ("j1", 1, "enqueue", ["x", "y"]), ("j1", 2, "claim", None), ("j2", 2, "cancel", None), ("j2", 1, "enqueue", ["z"]), ("j3", 1, "claim", None), ("j4", 1, "enqueue", []), ("j4", 2, "claim", None))
    query = start(seen)
    try:
        until(query, lambda: {r[:2] for r in seen} >= {("j1", "completed"), ("j4", "completed"), ("j2", "cancelled")})
    finally:
        query.stop()
    assert [r for r in seen if r[0] == "j1"] == [("j1", "queued", 0, 2, None), ("j1", "running", 0, 2, None), ("j1", "running", 1, 2, "x"), ("j1", "running", 2, 2, "y"), ("j1", "completed", 2, 2, None)]
    assert [r[1] for r in seen if r[0] == "j2"] == ["queued", "cancelled"] and not [r for r in seen if r[0] == "j3"]


def test_cancel_is_seen_between_items_and_state_outlives_a_restart(stream):
    send, start = stream
    seen: list = []
    items = [f"i{n}" for n in range(500)]
    send("a", ("j", 1, "enqueue", items), ("j", 2, "claim", None))
    query = start(seen)
    try:
        until(query, lambda: any(r[4] == "i1" for r in seen))
    finally:
        query.stop()
    again: list = []
    query = start(again)
    try:
        send("wake", ("k", 1, "enqueue", []))
        until(query, lambda: any(r[4] for r in again))
        send("b", ("j", 3, "cancel", None))
        until(query, lambda: any(r[1] == "cancelled" for r in again))
    finally:
        query.stop()
    again = [r for r in again if r[0] == "j"]
    taken = [r[4] for r in again if r[4]]
    assert again[-1][1] == "cancelled" and 2 <= again[-1][2] < 500 and again[-1][3] == 500
    #: Items go on where the first run left off, none left out; a batch cut off by the stop may come twice.
    assert taken == items[again[-1][2] - len(taken) : again[-1][2]] and items.index(taken[0]) <= len({r[4] for r in seen if r[4]})
    states = [r[1] for r in again]
    assert states.index("cancel_requested") < states.index("cancelled")


def test_worker_runs_each_batch_and_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ran: list = []
    for turn in ("a", "b"):
        (tmp_path / "in" / f"{turn}.json").write_text(json.dumps({"job_id": turn}))
        query = jobs.worker(spark.readStream.schema("job_id string").json(str(tmp_path / "in")), lambda df, _: ran.extend(r.job_id for r in df.collect()), str(tmp_path / "cp"))
        try:
            until(query, lambda turn=turn: turn in ran)
        finally:
            query.stop()
    assert ran == ["a", "b"]
