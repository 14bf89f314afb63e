"""Whitening by TSQR: no covariance is formed.

Vectors become integers. The fit list is each distinct one once, a table in the
shared folder. Its sums are exact. Each task centres its rows by n*x - S in
integers, so that nothing is lost before the first rounding, and keeps the R factor
of what it has seen; R factors are merged in a tree (QR of R factors on top of each
other). The singular values and right vectors of the last R are the root
eigenvalues (times root n) and eigenvectors of the covariance, without its squared
condition. Every row is then projected without a shuffle.

Edge cases: vectors that are null or hold a null, NaN or infinity are left out; of
vectors of unlike length the shorter ones end in zeros up to the longest; empty
vectors are all zero; repeated rows are one in the fit list and each a row of the
result; null ids are kept; components without variance (to rounding) have no
direction, their ``whitened`` is null and they take no part in the identity error;
an empty table gives no rows; integers beyond 2^52 raise an error; a
deviation beyond 64 bits is null; extra columns are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored
from .trees import column_sums, merged

SCALE, COMPONENTS = 256, 4
#: Rows that are factorised at once on top of the R so far.
ROWS = 4096
_MOST = 1 << 52


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``_id`` and ``_x`` (array of floor(scale * entry)) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)))
    fits = F.forall("_v", lambda c: F.abs(c) < F.lit(_MOST / scale))
    floors = F.transform("_v", lambda c: F.floor(c * F.lit(float(scale))))
    return rows.select("_id", F.when(fits, floors).otherwise(F.raise_error(F.lit("an entry is too large to be exact"))).alias("_x"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of 64-bit integers, shorter ones ended by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


class Centred:
    """Rows x as n*x - S: exact integers, Python's where 64 bits could be too few."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.most = n, sums, max(map(abs, sums), default=0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        top = int(np.abs(x).max()) if x.size else 0
        wide = self.n * top + self.most >= 1 << 62
        return x.astype(object) * self.n - np.array(self.sums, object) if wide else x * self.n - np.array(self.sums, np.int64)

    def doubles(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once."""
        return (self(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = self(x)
        if y.dtype != object and y.size and int(np.abs(y).max()) ** 2 * max(y.shape[1], 1) < 1 << 62:
            return (y * y).sum(1).tolist()
        whole = [sum(v * v for v in row) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in whole]


def upper(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for batch in batches:
            x = matrix(batch.column("_x"), width)
            total = [a + b for a, b in zip(total, [len(x), *column_sums(x)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int64()), pa.array(map(str, total), pa.string())], ["place", "v"])

    sums = fit.mapInArrow(run, "place bigint, v string").groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    of = {r.place: int(r.v) for r in sums.collect()}  # one number for each entry
    return of.get(0, 0), [of.get(i + 1, 0) for i in range(width)]


def _factors(fit: DataFrame, centred: Centred, width: int) -> DataFrame:
    """The R factor of each task's centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = centred.doubles(matrix(batch.column("_x").slice(at, ROWS), width))
                r = upper(np.concatenate([r, y]))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([0], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "segment", "payload"])

    return fit.mapInArrow(run, "part bigint, segment int, payload binary")


class Whitening:
    """Centre, directions and root eigenvalues, by falling eigenvalue."""

    def __init__(self, centred: Centred, r: np.ndarray, most: int):
        _, singular, right = np.linalg.svd(r, full_matrices=True)
        width = r.shape[1]
        singular = np.concatenate([singular, np.zeros(width - len(singular))])
        self.centred, self.n = centred, centred.n
        self.count = min(most, width)
        self.directions, self.roots = right[: self.count], singular[: self.count] / math.sqrt(self.n)
        trace = float((singular**2).sum())
        self.explained = [float(s * s / trace) if trace else None for s in singular[: self.count].tolist()]
        #: Directions whose variance is more than rounding.
        self.rank = int((singular[: self.count] > singular[0] * max(width, 1) * 1e-14).sum()) if trace else 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The first ``rank`` components of rows of integers."""
        return self.centred.doubles(x) @ self.directions[: self.rank].T / self.roots[: self.rank]


def _identity_error(fit: DataFrame, model: Whitening, width: int) -> float:
    """Largest absolute entry of the covariance of what is whitened, minus the identity."""
    k = model.rank
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model(matrix(batch.column("_x"), width))
            if len(w):
                own = w.mean(0)
                off, both = own - mean, n + len(w)
                spread += (w - own).T @ (w - own) + np.outer(off, off) * n * len(w) / both
                mean, n = mean + off * len(w) / both, both
        #: The means are zero but for rounding, so their squares are added without loss.
        values = [*(mean * n), *(spread + n * np.outer(mean, mean)).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array(values, pa.float64())], ["place", "v"])

    sums = fit.mapInArrow(run, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v"))
    of = {r.place: r.v for r in sums.collect()}  # one number for each pair of components
    mean = np.array([of[i] for i in range(k)]) / model.n
    cov = np.array([of[k + i] for i in range(k * k)]).reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id_col``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``: a row for each vector and component."""
    spark, rows = vectors.sparkSession, integers(vectors, id_col, vector_col, scale)
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    width = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], schema)
    #: Shorter vectors that differ by zeros at the end only are one.
    padded = F.concat("_x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("_x")))
    fit, path = stored(rows.select(F.when(F.size("_x") == width, F.col("_x")).otherwise(padded).alias("_x")).distinct(), "whitening-fit")
    centred = Centred(*_sums(fit, width))

    def merge(factors: list[bytes]) -> bytes:
        return upper(np.concatenate([np.frombuffer(f).reshape(-1, width) for f in factors])).tobytes()

    factor = merged(_factors(fit, centred, width), merge, "whitening-factors")[0]
    model = Whitening(centred, np.frombuffer(factor).reshape(-1, width), components)
    error = _identity_error(fit, model, width)
    drop(spark, path)
    k, rank = model.count, model.rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column("_x"), width)
                n = len(x)
                w = np.full((n, k), np.nan)
                w[:, :rank] = model(x)
                row = pa.array(np.repeat(np.arange(n), k))
                each = pa.array(centred.deviations(x), pa.int64())
                columns = [
                    part.column("_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, centred.n, np.int64)), each.take(row),
                    pa.array(w.ravel(), mask=np.tile(np.arange(k) >= rank, n)), pa.array(model.explained * n, pa.float64()), pa.array(np.full(n * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
