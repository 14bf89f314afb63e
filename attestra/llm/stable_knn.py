"""Nearest neighbours by stable random projections and a kd-tree.

Vectors are lengthened by one coordinate so that the largest inner product
becomes the least Euclidean distance, projected to ``DIMENSIONS`` Gaussian (2-stable)
directions, and each part of the table is indexed by a kd-tree over the
projections. A query walks the leaves in the order of their distance from its
projection and verifies what is in them in the original space. A projected
squared distance over the true one is chi-square with ``DIMENSIONS`` degrees of
freedom; the walk ends once anything nearer than the k-th neighbour so far
would, with probability ``CERTAINTY``, have been met in the leaves behind.

Every row is indexed. Rows are dealt to parts of about ``PART`` rows and queries to
blocks of ``BLOCK``; each pair of a part and a block is a task of its own, and
what leaves it is k rows for each query.

Edge cases: vectors that are null, empty or zero, of another length than most,
or hold a null, NaN or infinity take no part; ties go to the smaller id;
repeated ids are candidates of their own, but never of a query with that id; null
ids take no part; fewer candidates than k give fewer rows; extra columns are
passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS, CERTAINTY, LEAF = 6, 0.7, 64
PART, BLOCK = 16_384, 2_048
#: The leaves a query walks between two tests, as parts of all.
STEPS = (0.2, 0.4, 0.6, 0.8, 1.0)


def chi_square_quantile(p: float, degrees: int) -> float:
    """By bisection of the chi-square distribution (even degrees have a closed form)."""
    if degrees % 2:
        raise ValueError("an even number of dimensions is needed")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 20.0 * degrees
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """A kd-tree: rows in leaf order, and each leaf's box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, bounds = np.arange(len(points)), [(0, len(points))]
        while bounds and max(b - a for a, b in bounds) > leaf:
            new = []
            for a, b in bounds:
                if b - a <= leaf:
                    new.append((a, b))
                    continue
                rows = self.order[a:b]
                axis = int(np.argmax(np.ptp(points[rows], axis=0)))
                half = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(points[rows, axis], half)]
                new += [(a, a + half), (a + half, b)]
            bounds = new
        self.bounds = [(a, b) for a, b in bounds if b > a]
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in self.bounds]).reshape(-1, points.shape[1])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in self.bounds]).reshape(-1, points.shape[1])

    def squared_distances(self, query: np.ndarray) -> np.ndarray:
        """From each query to each leaf's box."""
        out = np.zeros((len(query), len(self.bounds)))
        for d in range(query.shape[1]):
            q = query[:, d, None]
            gap = np.maximum(np.maximum(self.low[None, :, d] - q, q - self.high[None, :, d]), 0)
            out += gap * gap
        return out


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, dimensions: int = DIMENSIONS, certainty: float = CERTAINTY, seed: int = 0) -> list[tuple]:
    """For each query up to k rows (query id, id, inner product), the largest first among those verified."""
    norms = (vectors * vectors).sum(1)
    most = norms.max()
    tail = np.sqrt(np.maximum(most - norms, 0))
    directions = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, dimensions))
    #: Queries of one length rank alike at any other; at this one distances are comparable.
    lengths = np.sqrt((queries * queries).sum(1))
    unit = queries * (np.sqrt(most) / lengths)[:, None]
    tree = Tree(vectors @ directions[:-1] + tail[:, None] * directions[-1])
    vectors, ids = vectors[tree.order], ids[tree.order]
    reach = tree.squared_distances(unit @ directions[:-1])
    rank = np.empty(reach.shape, np.int32)
    np.put_along_axis(rank, np.argsort(reach, axis=1), np.arange(reach.shape[1], dtype=np.int32)[None, :].repeat(len(reach), 0), 1)
    ordered, quantile, n = np.sort(reach, axis=1), chi_square_quantile(certainty, dimensions), len(tree.bounds)
    found: list[list] = [[] for _ in query_ids]
    best_scores = np.full((len(queries), k), -np.inf)
    by_id = np.argsort(ids, kind="stable")
    own_from, own_to = (np.searchsorted(ids[by_id], query_ids, side) for side in ("left", "right"))
    live, done = np.arange(len(queries)), 0
    for step in STEPS:
        upto = max(done, math.ceil(n * step))
        verified = np.full((len(live), len(ids)), -np.inf) if upto > done else None
        if verified is not None:
            for leaf, (a, b) in enumerate(tree.bounds):
                place = rank[live, leaf]
                rows = np.flatnonzero((place >= done) & (place < upto))
                if len(rows):
                    verified[rows, a:b] = queries[live[rows]] @ vectors[a:b].T
            for row in np.flatnonzero(own_to[live] > own_from[live]).tolist():
                verified[row, by_id[own_from[live[row]] : own_to[live[row]]]] = -np.inf
            for row, q in enumerate(live.tolist()):
                scores = verified[row]
                floor = best_scores[q, -1]
                if len(scores) > k:
                    floor = max(floor, np.partition(scores, len(scores) - k)[len(scores) - k])
                #: Products of equal vectors may differ in their last bits from block to block; these do not.
                near = np.flatnonzero((scores >= floor - 1e-9 * most) & (scores > -np.inf))
                exact = (vectors[near] * queries[q]).sum(1)
                found[q] += zip((-exact).tolist(), ids[near].tolist(), strict=True)
                found[q] = sorted(found[q])[:k]
                for i, (s, _) in enumerate(found[q]):
                    best_scores[q, i] = -s
            done = upto
        if done >= n:
            break
        #: Squared distance of the k-th neighbour: both have squared length ``most``, after lengthening.
        kth = 2 * most - 2 * best_scores[live, -1] * np.sqrt(most) / lengths[live]
        live = live[~(ordered[live, done] > quantile * np.maximum(kth, 0))]
        if not len(live):
            break
    return [(q, i, -s) for q, rows in zip(query_ids.tolist(), found, strict=True) for s, i in rows]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part: of the most frequent length, finite, not zero."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0))
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("vector", lambda x: x != 0))
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (width["n"] if width else 0))


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", part: int = PART, block: int = BLOCK, dimensions: int = DIMENSIONS, certainty: float = CERTAINTY) -> DataFrame:
    """``query_id``, ``rank``, ``id_col`` and ``score`` of the k nearest of each row whose id ``every`` divides."""
    rows = usable(vectors, id_col, vector_col)
    queries = rows.where(F.col("id") % every == 0)
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    parts, blocks = max(1, -(-n // part)), max(1, -(-n_queries // block))
    mine = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    points = rows.select("id", "vector", mine.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    asked = queries.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), own.alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            t = t.combine_chunks()
            flat = t["vector"].combine_chunks().flatten().to_numpy()
            return t["id"].to_numpy(), flat.reshape(len(t), -1)

        found: list[tuple] = []
        if len(left) and len(right):
            ids, points = arrays(left)
            query_ids, asked = arrays(right)
            for at in range(0, len(asked), 256):
                found += search(ids, points, query_ids[at : at + 256], asked[at : at + 256], k, dimensions, certainty)
        of = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(of[0], pa.int64()), "id": pa.array(of[1], pa.int64()), "score": pa.array(of[2], pa.float64())})

    tasks = points.groupBy("part", "block").cogroup(asked.groupBy("part", "block"))
    found = tasks.applyInArrow(run, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
