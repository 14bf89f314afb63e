"""What the operators of this subpackage share: tables, intermediate storage, words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About this many bytes of text are held as Python or numpy objects at once.
CHUNK_BYTES = 2 << 20


#: Rows of long texts that go to a Python worker at once; a batch of them is held by the JVM and the worker alike.
BATCH_ROWS = 2000


def modest_batches(spark: SparkSession, most_bytes: int | None = None) -> None:
    """Keep this session's Arrow batches to ``BATCH_ROWS`` rows at most, and to ``most_bytes``, if given."""
    if most_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset (tests, local
    mode) a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL["dir"] = _LOCAL.get("dir") or _scratch()
    return f"{base.rstrip('/')}/attestra-{spark.sparkContext.applicationId}"


_LOCAL: dict = {}
#: The C library, where it is glibc.
_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def _scratch() -> str:
    folder = tempfile.TemporaryDirectory(prefix="attestra-")
    atexit.register(folder.cleanup)
    return folder.name


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; what reads it has no longer lineage.

    Returns the table and its path, for :func:`drop` once nothing reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


#: Once a table is written, nothing reads the shuffle files that led to it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that :func:`stored` wrote."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of text; a longer text is a part alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trimmed()


def trimmed() -> None:
    """Give freed memory back to the system: a worker lives on for later stages beside others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 of every word of every text, one after another, and each text's number of words.

    Words are what ``bytes.split`` yields: runs without space, tab, line feed,
    vertical tab, form feed and carriage return.
    """
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hasher = xxhash.xxh3_64_intdigest
    flat = np.fromiter((hasher(w, seed) for t in words for w in t), np.uint64, int(counts.sum()))
    return flat, counts


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring hashes; entry i is of h[i:i+k], shorter at the end.

    A polynomial in ``base`` (odd) modulo 2**64, put together from runs whose
    lengths are powers of two, then mixed.
    """

    def joined(first: np.ndarray, length: int, second: np.ndarray, more: int) -> np.ndarray:
        out = first * np.uint64(pow(base, more, 1 << 64))
        out[: max(len(h) - length, 0)] += second[length:]
        return out

    out, done, power, length = None, 0, h, 1
    while k:
        if k & 1:
            out = power if out is None else joined(out, done, power, length)
            done += length
        k >>= 1
        if k:
            power, length = joined(power, length, power, length), 2 * length
    return mixed(out)


def crc_fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts))


def thinned(df: DataFrame, label: str, order: str, sizes: dict, most: int) -> DataFrame:
    """Rows among which are the ``most`` of each label with the least ``order``, a 64-bit hash.

    ``sizes`` are the labels' numbers of rows, about. What hashes above four times
    the share that is wanted goes before anything is ranked, so that a label of any
    size leaves some ``4 * most`` rows.
    """
    keep = F.lit(False)
    for value, n in sizes.items():
        share = min(1.0, 4 * most / max(n, 1))
        keep = keep | ((F.col(label) == value) & (F.col(order) < F.lit(min(int(-(2**63) + share * 2**64), 2**63 - 1))))
    return df.where(keep)
