"""Streams: windowed counts of events, and the state of jobs from a stream of their events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merges import TRANSITIONS


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Events and their distinct types by tumbling window; works on a stream (with a watermark) and on a table."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", window), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Events by session: a gap ends one."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.session_window("_at", gap), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def job_states(events: DataFrame, job: str = "job_id", seq: str = "seq", event: str = "event") -> DataFrame:
    """The state of each job after every batch with events of it, by arbitrary state per job.

    Events of a job are folded in the order of ``seq`` within a batch; what does
    not fit the state is passed over, as in the batch form of the same fold.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("none", 0)
        rows = pd.concat(list(batches)).sort_values(seq)
        for e in rows[event]:
            now = TRANSITIONS.get((now, e), now)
        n += len(rows)
        state.update((now, n))
        yield pd.DataFrame({job: [key[0]], "state": [now], "events": [n]})

    kind = events.schema[job].dataType.simpleString()
    return events.groupBy(job).applyInPandasWithState(fold, f"{job} {kind}, state string, events bigint", "state string, events bigint", "update", GroupStateTimeout.NoTimeout)


def worker(queued: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, every: str = "0.5 seconds") -> StreamingQuery:
    """Run ``process`` on each batch of queued jobs; restarts go on from the checkpoint."""
    return queued.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
