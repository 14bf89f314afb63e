"""Sums and merges of what tasks have each made of their rows, without one task that meets them all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

#: Parts that one merge takes together.
FAN_IN = 16
#: Sums in numpy stay below this, so that 64 bits hold them.
_WIDE = 1 << 62


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], label: str, fan_in: int = FAN_IN) -> dict[int, bytes]:
    """For each ``segment`` the one payload that ``merge`` makes of all; columns part, segment, payload.

    Parts are merged in a tree of groups of ``fan_in``, so a group never holds more
    than as many payloads, however many tasks there were. Each level is a table in
    the shared folder. What comes to the driver is one payload of each segment.
    """
    spark = parts.sparkSession

    def run(group: pa.Table) -> pa.Table:
        return pa.table({"part": group["part"][:1], "segment": group["segment"][:1], "payload": pa.array([merge(group["payload"].to_pylist())], pa.binary())})

    level, path = stored(parts.select("part", "segment", "payload"), label)
    most = level.agg(F.max("part")).first()[0] or 0
    while most:
        most //= fan_in
        above = level.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part", "segment").applyInArrow(run, "part bigint, segment int, payload binary")
        above, above_path = stored(above, label)
        drop(spark, path)
        level, path = above, above_path
    found: dict[int, list[bytes]] = {}
    for r in level.collect():
        found.setdefault(r.segment, []).append(bytes(r.payload))
    drop(spark, path)
    return {k: v[0] if len(v) == 1 else merge(v) for k, v in found.items()}


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of a matrix of 64-bit integers."""
    if not len(x):
        return [0] * x.shape[1]
    if int(np.abs(x).max()) * len(x) < _WIDE:
        return x.sum(0).tolist()
    return [sum(c) for c in x.T.tolist()]
