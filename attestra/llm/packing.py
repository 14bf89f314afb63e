"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents (pieces of at most ``CAPACITY`` tokens) and gaps are kept in order of
size. Sizes are whole numbers up to the capacity, so all of one size form a run
in that order, and a round moves whole runs: the documents of the largest size
left look for their successor among the gaps (the least gap that they fit);
document number r of the run takes gap number r of that gap's run, which settles
conflicts by rank; the filled gaps are put back in order with what is left of
them, and the sweep repeats until the documents are placed. Where none fits, new
sequences are opened. That is best-fit decreasing on all rows at once.

The rounds work on runs, not documents, however many these are, so they run on
the driver on a histogram of at most ``CAPACITY`` numbers. (The same rounds as
DataFrames of runs, a stored table each, took 2.5 to 4 s a round and some forty
rounds, for one sequence more; so they stay here.) All that touches documents is distributed: tokenising, the
rank of a piece among those of its size (its number within a task plus the
numbers of the tasks before) and finding the run that holds it. No size is
gathered in one task, however many pieces share it.

Edge cases: a null or empty text is the end token alone; a text of several
times the capacity gives full pieces after a first, maybe shorter one; repeated
rows and null ids are placed like any other; extra columns are passed by; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import SLICE, content, forget, ready
from .common import slices, stored

CAPACITY, END_ID = 1024, 2
#: Runs that are broadcast to find pieces; more are joined by size.
SENT = 100_000


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; only the first may be shorter than the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_tokenizer: bool = True) -> DataFrame:
    """Every document's pieces: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    ``task`` and ``nth`` number the pieces of a length within the task that made them.
    """
    kind, data = content(path)
    shipped = docs.sparkSession.sparkContext.broadcast(data)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, task = ready(kind, shipped.value, pattern), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                rows = []
                flat, n = bpe.encode_all(part.column("_text"))
                for i, one in enumerate(np.split(flat, np.cumsum(n)[:-1])):
                    ids = one.tobytes() + end
                    for p, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        rows.append((i, p, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                        seen[length] += 1
                of = np.array(rows, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(pa.array(of[0])), pa.array(of[1].astype(np.int32)), *(pa.array(c) for c in of[2:5]), pa.array(np.full(len(rows), task, np.int32)), pa.array(of[5])],
                    ["_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
        if not keep_tokenizer:
            del bpe
            forget()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")
    return out.withColumnRenamed("_id", id_col)


def best_fit(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the documents of each size go: (size, first rank, rank beyond, first sequence, offset).

    The document of rank r goes to sequence ``first sequence + r - first rank``.
    """
    if sizes and (min(sizes) < 1 or max(sizes) > capacity):
        raise ValueError("sizes are from 1 to the capacity")
    gaps: dict[int, deque] = {}
    order: list[int] = []
    placed, opened = [], 0

    def add(gap: int, first: int, beyond: int) -> None:
        if gap not in gaps:
            gaps[gap] = deque()
            insort(order, gap)
        gaps[gap].append((first, beyond))

    for size in sorted(sizes, reverse=True):
        rank, count = 0, sizes[size]
        while rank < count:
            at = bisect_left(order, size)
            if at == len(order):
                new = -(-(count - rank) // (capacity // size))
                add(capacity, opened, opened + new)
                opened += new
                continue
            gap = order[at]
            first, beyond = gaps[gap].popleft()
            take = min(count - rank, beyond - first)
            placed.append((size, rank, rank + take, first, capacity - gap))
            if first + take < beyond:
                gaps[gap].appendleft((first + take, beyond))
            if not gaps[gap]:
                del gaps[gap], order[at]
            if gap > size:
                add(gap - size, first, first + take)
            rank += take
    return placed


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; needs ``length``, ``task`` and ``nth`` as from :func:`pieces`.

    ``parts`` is read several times and must not change; pass a stored table.
    """
    spark = parts.sparkSession
    counts = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit(sizes, capacity)
    #: A row for each run: some thousands at this capacity, whatever the number of documents.
    found = spark.createDataFrame(runs, "_length bigint, _first bigint, _beyond bigint, _sequence bigint, offset bigint")
    ranked = parts.join(offsets, ["length", "task"]).withColumn("_rank", F.col("earlier") + F.col("nth"))
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_beyond"))
    out = ranked.join(F.broadcast(found) if len(runs) <= SENT else found, here).withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_first"))
    return out.select(*[c for c in parts.columns if c not in ("task", "nth")], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_tokenizer: bool = True) -> DataFrame:
    """Tokenise, cut and pack whole documents. Without ``keep_tokenizer`` each task builds its own and gives it up, for sessions whose workers go on to other things."""
    parts, _ = stored(pieces(docs, path, pattern, id_col, text_col, capacity, end_id, keep_tokenizer), "pieces")
    return packed(parts, capacity)
