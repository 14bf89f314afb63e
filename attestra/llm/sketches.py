"""Document fingerprints: threshold-scaled sketches.

A sketch retains every shingle hash below a fixed fraction of the hash range, so
sketches of very unequal documents compare on the same part of that range:
the likeness or containment of the retained hashes estimates that of the
shingles, and the sketch of two documents together is the union of theirs.
One fraction holds for the whole corpus, whatever a text's length; a short text
retains few hashes, and its estimates are the coarser for it.

A fingerprint is the sorted retained hashes, 16 hex digits each, so equal texts
have equal fingerprints and no other state is needed to compare or merge them.

``edit_checks`` pairs each row with the next one in order of an id without
putting the table in one task: rows are dealt by ranges of the id (and of a hash
of the text, which parts equal ids), and the first row of each range is also
dealt to the range before.

Edge cases: a null or empty text has no shingle and an empty fingerprint; two
empty fingerprints are alike (1), one empty and one not are unlike (0); fewer
words than a shingle make one shingle; ids may be of any type that sorts, equal
ids are ordered by a hash of their text, null ids come first; extra columns are
passed by; in a table of one row, the row itself comes next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mixed, partitions, run_hashes, slices, word_hashes

SHINGLE, FRACTION = 5, 1 / 4
#: Ids looked at for each range when its bounds are chosen.
LOOKED_AT = 40
_BASE = 0x9FB21C651E98DF25


def sketches(texts: list[bytes], k: int = SHINGLE, fraction: float = FRACTION) -> list[np.ndarray]:
    """The sorted retained hashes of each text's distinct shingles of ``k`` words, A-Z lower-cased."""
    words, counts = word_hashes([t.lower() for t in texts])
    ends = np.cumsum(counts)
    hashes, limit, out = run_hashes(words, k, _BASE), np.uint64(min(int(fraction * 2**64), 2**64 - 1)), []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        #: Fewer words than a shingle: the hash of all, told from longer runs by their number.
        own = hashes[end - n : end - k + 1] if n >= k else mixed(run_hashes(words[end - n : end], n, _BASE)[:1] ^ np.uint64(n))
        out.append(np.unique(own[own < limit]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the documents' shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated part of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents together (shingles that span both apart)."""
    return np.union1d(a, b)


def spelt(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """``id_col`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [(t or "").encode() for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(map(spelt, sketches(texts, k, fraction)), pa.string())], ["_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("_id", id_col)


def in_ranges(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Rows (``_id``, ``_text``) dealt by ranges of ``_id`` and ``_tie``, a hash of the text: adds ``_tie``, ``_range`` and ``_guest``.

    A guest is the row with which the next range begins. The bounds are
    quantiles of a bounded number of rows, those with the least hashes.
    """
    keyed = rows.withColumn("_tie", F.xxhash64("_text"))
    place = F.struct("_id", "_tie")
    begins: list = []
    if parts > 1:
        some = keyed.where(F.col("_id").isNotNull()).select("_id", "_tie").orderBy(F.xxhash64("_id", "_tie"), "_id", "_tie").limit(LOOKED_AT * parts).collect()
        seen = sorted(set(map(tuple, some)))
        begins = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []
    kind = rows.schema["_id"].dataType
    bounds = [F.struct(F.lit(i).cast(kind).alias("_id"), F.lit(tie).cast("long").alias("_tie")) for i, tie in begins]
    own, guest = _range_of(place, bounds), place.isin(bounds) if bounds else F.lit(False)
    one = F.struct(own.alias("range"), F.lit(0).alias("guest"))
    both = F.array(one, F.struct((own - 1).alias("range"), F.lit(1).alias("guest")))
    out = keyed.select("*", F.explode(F.when(guest, both).otherwise(F.array(one))).alias("_r"))
    return out.select("_id", "_text", "_tie", F.col("_r.range").alias("_range"), F.col("_r.guest").alias("_guest")), len(begins) + 1


def _range_of(value: F.Column, begins: list[F.Column]) -> F.Column:
    """How many of the sorted ``begins`` are at most the value, by halving; a null id sorts first."""

    def among(low: int, high: int) -> F.Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= begins[mid], among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, len(begins)).cast("int")


def edit_checks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text and of an edit of it, and how alike they and the next document's are.

    The edit: the last floor(n/2) of its n code points give way to the first as
    many (or all) of the next document by id; the first comes after the last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    #: Nulls are less than all else in a struct, as in the order of the rows.
    head = rows.select("_text", F.struct("_id", F.xxhash64("_text").alias("_tie")).alias("_place")).agg(F.min_by("_text", "_place").alias("_text")).first()
    first = spark.sparkContext.broadcast((head["_text"] if head else None) or "")
    dealt, n = in_ranges(rows, partitions(spark))
    dealt = dealt.repartitionById(n, "_range").sortWithinPartitions("_range", "_guest", "_id", "_tie", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = list(zip(part.column("_id").to_pylist(), part.column("_text").to_pylist(), part.column("_range").to_pylist(), part.column("_guest").to_pylist(), strict=True))
                rows = ([held] if held else []) + rows
                yield made(rows)
                held = rows[-1]
        if held:
            yield made([held, (None, first.value, held[2], 1)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        """Rows but the last, which is the next one of the last but one."""
        texts = [text for _, text, _, _ in rows]
        at = [i for i in range(len(rows) - 1) if not rows[i][3]]
        #: Only the last range has no guest; the first document follows it.
        after = [texts[i + 1] if rows[i + 1][2] == rows[i][2] else first.value for i in at]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + t[: len(texts[i]) // 2] for i, t in zip(at, after, strict=True)]
        own = sketches([texts[i].encode() for i in at], k, fraction)
        changed = sketches([t.encode() for t in edited], k, fraction)
        nexts = [own[j + 1] if j + 1 < len(at) and at[j + 1] == i + 1 and rows[i + 1][2] == rows[i][2] else sketches([t.encode()], k, fraction)[0] for j, (i, t) in enumerate(zip(at, after, strict=True))]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in at], id_arrow), pa.array([len(texts[i]) for i in at], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
             pa.array(map(spelt, own), pa.string()), pa.array(map(spelt, changed), pa.string()),
             pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
             pa.array([likeness(a, b) for a, b in zip(own, nexts, strict=True)], pa.float64())],
            ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    id_arrow = to_arrow_type(rows.schema["_id"].dataType)
    kind = rows.schema["_id"].dataType.simpleString()
    out = dealt.mapInArrow(run, f"_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("_id", id_col)
