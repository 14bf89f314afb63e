"""Centroid clustering of integer vectors by Lloyd rounds with Hamerly's bounds.

Every vector keeps one upper bound of the distance to its own centroid and one
lower bound of that to any other. When centroids move, the upper bound grows by
its own centroid's drift and the lower shrinks by the largest drift of the others.
A vector whose upper bound is below the lower one, or below half the way from its
centroid to the nearest other one, cannot change; only the rest measure their
own centroid anew, and those still in doubt scan all centroids with integers.
Bounds are rounded outwards, and only a strict gap skips a scan, so clusters and
ties are those of full scans.

The vectors with their bounds are a table in the shared folder, written anew in
each round without a shuffle; a lost executor costs its tasks of one round. Sums of
a cluster change by the vectors that moved, added up exactly in each task, then
over tasks. The driver holds the centroids and their sums only.

Edge cases: vectors that are null, of another length, or hold a null, NaN or
infinity are left out; repeated rows are clustered each by itself; a null id is
kept and drawn by the hash of an empty id; equal hashes are drawn in the order of
their vectors; with fewer vectors than centroids there are as many as vectors;
an empty table gives no rows; integers at or beyond 2^27 (whose squared distances 64
bits may not hold) raise an error; sums of distances beyond 64 bits are null; extra
columns are passed by.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

LENGTH, SCALE = 64, 256
#: Integers below this have products that doubles add up exactly; up to the other one 64-bit integers do.
_EXACT, _MOST = 1 << 22, 1 << 27
_OUT = 1 + 1e-12


def integers(vectors: DataFrame, id_col: str, vector_col: str, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """``_id`` and ``_x`` (array of floor(scale * entry)) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.where((F.size("_v") == length) & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)))
    fits = F.forall("_v", lambda c: F.abs(c) < F.lit(_MOST / scale))
    floors = F.transform("_v", lambda c: F.floor(c * F.lit(float(scale))).cast("int"))
    return rows.select("_id", F.when(fits, floors).otherwise(F.raise_error(F.lit("an entry is too large for exact distances in 64 bits"))).alias("_x"))


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose salted id hashes least, in the order of the hashes."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    first = rows.select(F.sha2(name, 256).alias("_h"), "_x").orderBy("_h", "_x").limit(k).collect()
    return np.array([r._x for r in first], np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact, of every row to every centroid."""
    own, theirs = (x * x).sum(1), (centroids * centroids).sum(1)
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        cross = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        cross = x @ centroids.T
    return own[:, None] - 2 * cross + theirs[None]


class Step:
    """One assignment: ``centroids``, and how far each has moved since the bounds were kept (None at first)."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        apart = squared_distances(centroids, centroids)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        #: Below half the way to the nearest other centroid no other one can be as near.
        self.half = np.sqrt(apart.min(1).astype(np.float64)) / 2 / _OUT if k > 1 else np.full(k, np.inf)
        self.drift = self.others = None
        if before is not None:
            moved = ((centroids - before) ** 2).sum(1)
            self.drift = np.sqrt(moved.astype(np.float64)) * _OUT
            order = np.argsort(self.drift)
            #: The largest drift of any other centroid.
            self.others = np.full(k, self.drift[order[-1]])
            self.others[order[-1]] = self.drift[order[-2]] if k > 1 else 0.0

    def __call__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New clusters and bounds, and how many vectors were scanned in full."""
        cluster, doubt = cluster.copy(), np.arange(len(x))
        if self.drift is not None and len(x):
            upper = (upper + self.drift[cluster]) * _OUT
            lower = np.maximum(lower / _OUT - self.others[cluster], 0) / _OUT
            doubt = np.flatnonzero(upper >= np.maximum(lower, self.half[cluster]))
            own = ((x[doubt] - self.centroids[cluster[doubt]]) ** 2).sum(1)
            upper[doubt] = np.sqrt(own.astype(np.float64)) * _OUT
            doubt = doubt[upper[doubt] >= np.maximum(lower[doubt], self.half[cluster[doubt]])]
        else:
            upper, lower = np.zeros(len(x)), np.zeros(len(x))
        if len(doubt):
            far = squared_distances(x[doubt], self.centroids)
            best = far.argmin(1)
            at = np.arange(len(doubt))
            upper[doubt] = np.sqrt(far[at, best].astype(np.float64)) * _OUT
            far[at, best] = np.iinfo(np.int64).max
            lower[doubt] = np.sqrt(far.min(1).astype(np.float64)) / _OUT if len(self.centroids) > 1 else np.inf
            cluster[doubt] = best
        return cluster, upper, lower, len(doubt)


def _assigned(state: DataFrame, step: Step, length: int, last: bool) -> DataFrame:
    """``state`` after one step. ``_was`` is the cluster before; ``_d`` the squared distance, worked out in the last step only."""
    first = "_cluster" not in state.columns
    kind = state.schema["_id"].dataType.simpleString()
    names = ["_id", "_x", "_cluster", "_was", "_upper", "_lower", "_scanned", "_d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("_x").flatten().to_numpy().reshape(n, length).astype(np.int64)
            if first:
                was, upper, lower = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
            else:
                was, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cluster", "_upper", "_lower"))
            cluster, upper, lower, scanned = step(x, was, upper, lower)
            counted = np.zeros(n, np.int64)
            counted[:1] = scanned
            d = ((x - step.centroids[cluster]) ** 2).sum(1) if last else np.zeros(n, np.int64)
            was = np.full(n, -1, np.int32) if first else was
            columns = [batch.column("_id"), batch.column("_x"), *(pa.array(c) for c in (cluster.astype(np.int32), was, upper, lower, counted, d))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return state.mapInArrow(run, f"_id {kind}, _x array<int>, _cluster int, _was int, _upper double, _lower double, _scanned bigint, _d bigint")


def _changes(state: DataFrame, k: int, length: int) -> np.ndarray:
    """What the step adds to each cluster's count (column 0) and sums: of the vectors that moved only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, length + 1), object)
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, length).astype(np.int64)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
            for column, sign in (("_cluster", 1), ("_was", -1)):
                of = batch.column(column).to_numpy(zero_copy_only=False)
                for c in np.unique(of[of >= 0]).tolist():
                    total[c] += sign * x[of == c].sum(0)
        rows = np.flatnonzero((total != 0).any(1))
        place = np.add.outer(rows * (length + 1), np.arange(length + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total[rows].ravel().tolist(), pa.int64())], ["place", "v"])

    moved = state.where("_cluster <> _was").select("_x", "_cluster", "_was")
    sums = moved.mapInArrow(run, "place bigint, v bigint").groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = np.zeros(k * (length + 1), object)
    for r in sums.collect():  # one number for each centroid and component
        out[r.place] = int(r.v)
    return out.reshape(k, length + 1)


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", length: int = LENGTH, scale: int = SCALE, scans: list | None = None
) -> DataFrame:
    """``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector that takes part.

    ``scans`` gets the number of full scans of each step, if given.
    """
    spark, rows = vectors.sparkSession, integers(vectors, id_col, vector_col, length, scale)
    centroids = seeds(rows, k, salt)
    k = len(centroids)
    kind = rows.schema["_id"].dataType.simpleString()
    if not k:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    state, path, before, sums = rows, None, None, np.zeros((k, length + 1), object)
    for nth in range(rounds + 1):
        new, new_path = stored(_assigned(state, Step(centroids, before), length, nth == rounds), "clusters")
        if path:
            drop(spark, path)
        state, path = new, new_path
        if scans is not None:
            scans.append(state.agg(F.sum("_scanned")).first()[0])
        if nth < rounds:
            sums = sums + _changes(state, k, length)
            before, centroids = centroids, centroids.copy()
            for c in range(k):
                if sums[c, 0]:
                    centroids[c] = [s // sums[c, 0] for s in sums[c, 1:].tolist()]
    total = F.sum(F.col("_d").cast("decimal(38,0)"))
    each = {r._cluster: int(r.v) for r in state.groupBy("_cluster").agg(total.alias("v")).collect()}  # one row for each centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    held = lambda v: F.lit(v if v < 1 << 63 else None).cast("bigint")
    of_cluster = lambda values: F.element_at(F.array(*values), F.col("_cluster") + 1)
    return state.select(
        F.col("_id").alias(id_col), F.col("_cluster").alias("cluster"), F.col("_d").alias("distance"), of_cluster([held(each.get(c, 0)) for c in range(k)]).alias("cluster_inertia"),
        held(sum(each.values())).alias("inertia"), of_cluster([F.lit(d) for d in digests]).alias("centroid_sha256"),
    )
