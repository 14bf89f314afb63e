"""SimHash near-duplicates, compared in bit-sliced form.

Fingerprints of 64 bits are cut into m bit ranges and joined on every choice of
m - 4 of them: two fingerprints at four or fewer differing bits agree on at least
so many, so no pair is missed. m grows with the number of fingerprints (six up to
2^26, then seven, eight), so that keys get longer (21 to 32 bits) and buckets stay
small. Five ranges make a third of the keys of six, so where the one gives way to the
other, three times as many rows meet; hence few fingerprints have six as well. Rows that agree lie side by side after a sort; their bits are turned
into planes once (bit i of 64 neighbours in one word). For neighbours at each
distance in the bucket the planes meet themselves, shifted by as many places, and
the distances of 64 pairs at a time are counted with carry-save adders. Words
whose pairs all exceed the radius, or are of two buckets, are left.

A bucket only yields a spanning forest of its links, never all of its pairs,
and a bucket larger than ``BUCKET`` is dealt out as pairs of its parts, so
that no task holds a whole hot bucket. Links then go through alternating
large-star and small-star rounds until nothing changes.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; repeated rows share a fingerprint and a component; a null id takes part
in its group, and is its ``component_id`` only if no id there is known; other
columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, partitions, slices, stored, text_bytes

SHINGLE, RADIUS = 4, 4
#: Up to so many fingerprints 6 and 7 bit ranges are cut, beyond them 8.
MOST = ((1 << 26, 6), (1 << 32, 7))
#: Fingerprints of one bucket that a task compares with each other at most.
BUCKET = 2048
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``k`` words of a lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined, hasher = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [hasher(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def fingerprints_of(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """One SimHash for each text."""
    lists = [shingle_hashes(t, k) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        for bit in range(64):
            ones = np.add.reduceat(((flat >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
            out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``bits`` (the fingerprint as a signed 64-bit integer) of every row."""
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                bits = fingerprints_of(text_bytes(part.column("_text")), k)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(bits.view(np.int64))], ["_id", "bits"])

    kind = df.schema["_id"].dataType.simpleString()
    return df.mapInArrow(run, f"_id {kind}, bits bigint").withColumnRenamed("_id", id_col)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_places(planes: np.ndarray, by: int, asked: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Places i (of ``asked``, a mask, 64 to a word) whose value and that of place i + ``by`` differ in at most ``radius`` bits; as a mask.

    Three planes at a time pass a carry-save adder into vertical counters. Words
    without a pair left within the radius drop out.
    """
    live = np.flatnonzero(asked)
    over = ~asked
    digits = max(2, radius.bit_length())
    counter = np.zeros((digits, len(live)), np.uint64)
    words, bits = divmod(by, 64)
    width, left, right = planes.shape[1], np.uint64(64 - bits if bits else 0), np.uint64(bits)
    for at in range(0, 64, 3):
        near, next_ = live + words, live + words + 1
        part = []
        for b in range(at, min(at + 3, 64)):
            plane = planes[b]
            other = np.where(near < width, plane[np.minimum(near, width - 1)], 0) >> right
            if bits:
                other |= np.where(next_ < width, plane[np.minimum(next_, width - 1)], 0) << left
            part.append(plane[live] ^ other)
        part += [np.zeros(len(live), np.uint64)] * (3 - len(part))
        a, b, c = part
        half, beyond = a ^ b, over[live]
        for weight, carry in ((0, half ^ c), (1, (a & b) | (half & c))):
            for i in range(weight, digits):
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            beyond |= carry
        more, same = np.zeros(len(live), np.uint64), np.full(len(live), _FULL)
        for i in reversed(range(digits)):
            if radius >> i & 1:
                same &= counter[i]
            else:
                more |= same & counter[i]
                same &= ~counter[i]
        beyond |= more
        over[live] = beyond
        stay = beyond != _FULL
        if not stay.all():
            live, counter = live[stay], counter[:, stay]
            if not len(live):
                break
    return ~over


def places(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def mask_of(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(flags) // 64) * 64, bool)
    out[: len(flags)] = flags
    return np.packbits(out, bitorder="little").view(np.uint64)


class Forest:
    """Union-find over positions; a union keeps the smaller root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def bucket_links(keys: np.ndarray, sides: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links inside runs of equal keys (sorted) that make a spanning forest of each run.

    ``sides`` is 0 or 1 where a run compares two parts of a hot bucket (only
    pairs across count there; pairs inside are some other run's), else 2.
    """
    n, links = len(keys), []
    if n < 2:
        return links
    forest, planes = Forest(n), planes_of(values)
    #: How far on the last row of each row's run is.
    ends = np.searchsorted(keys, keys, side="right") - 1 - np.arange(n)
    for shift in range(1, int(ends.max()) + 1):
        asked = ends >= shift
        rows = np.flatnonzero(asked)
        asked[rows] &= (sides[rows] == 2) | (sides[rows] != sides[rows + shift])
        for i in places(near_places(planes, shift, mask_of(asked), radius), n).tolist():
            if forest.join(i, i + shift):
                links.append((i, i + shift))
    return links


def ranges_of(count: int) -> list[tuple[int, int]]:
    """Bit ranges (first, width) for a number of fingerprints; all but four of them make a key."""
    m = next((m for most, m in MOST if count <= most), 8)
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def similar(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``bits``); a spanning forest of each bucket.

    ``radius`` is at most 4, for which the bit ranges find every pair.
    """
    if radius > RADIUS:
        raise ValueError("the bit ranges find pairs of up to four differing bits")
    spark = prints.sparkSession
    ranges = ranges_of(prints.count())
    piece = [F.shiftrightunsigned("bits", first).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for first, width in ranges]
    keys = F.array(*[
        F.xxhash64(F.lit(i), *[piece[p] for p in chosen]) for i, chosen in enumerate(combinations(range(len(ranges)), len(ranges) - RADIUS))
    ])
    rows = prints.select("bits", F.explode(keys).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > bucket)
    hot = hot.select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / bucket).cast("int").alias("parts"))
    marked = rows.join(hot, F.col("key") == F.col("hot_key"), "left")
    #: Part i of a hot bucket meets every part j, once as the lower and once as the upper side.
    mine = F.pmod(F.xxhash64("bits", F.lit(7)), F.col("parts").cast("long")).cast("int")
    every = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(F.least(j, F.col("mine")).alias("lo"), F.greatest(j, F.col("mine")).alias("hi"), F.when(j == F.col("mine"), 2).when(j > F.col("mine"), 0).otherwise(1).alias("side")),
    )
    one = F.array(F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(2).alias("side")))
    dealt = marked.withColumn("mine", F.coalesce(mine, F.lit(0))).select(
        "bits", "key", F.explode(F.when(F.col("parts").isNull(), one).otherwise(every)).alias("m")
    )
    dealt = dealt.select("bits", F.col("m.side").cast("int").alias("side"), F.xxhash64("key", "m.lo", "m.hi").alias("deal"))
    dealt = dealt.repartition(partitions(spark), "deal").sortWithinPartitions("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in (2, 1, 0)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            yield from found(*(x[:cut] for x in now))
        if rest is not None:
            yield from found(*rest)

    def found(keys: np.ndarray, sides: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        links = np.array(bucket_links(keys, sides, bits.view(np.uint64), radius), np.int64).reshape(-1, 2)
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(bits[links[:, 0]]), pa.array(bits[links[:, 1]])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and hash sums of the links: alike only if a round changed nothing."""
    wide = "decimal(38,0)"
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast(wide)), F.sum(F.hash("b", "a").cast(wide))).first())


def components(links: DataFrame, label: str = "component") -> tuple[DataFrame, list[str]]:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``links`` (a, b).

    Alternating large-star and small-star rounds. Each round's links are a
    table in the shared folder, so that a lost executor costs one round. A
    star's centre may have many links; they are summed up by a partial
    minimum and joined back, never gathered.
    """
    spark = links.sparkSession
    edges, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    paths, before = [path], _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        # Large star: each larger neighbour of a centre goes to the centre's least neighbour.
        large = edges.join(low, F.col("b") == F.col("c")).select("a", F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node's smaller neighbours and itself go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "c"), F.col("a") == F.col("c"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after, path = stored(small.where("a <> b").distinct(), label)
        drop(spark, paths.pop())
        edges, paths, now = after, [path], _state(after)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), paths


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``."""
    marks, path = stored(fingerprints(docs, id_col, text_col, k), "simhash")
    classes = marks.groupBy("bits").agg(F.min(id_col).alias("_least"))
    classes, class_path = stored(classes, "simhash-classes")
    links, link_path = stored(similar(classes.select("bits"), radius), "simhash-links")
    roots, _ = components(links, "simhash-stars")
    drop(docs.sparkSession, link_path)
    #: Classes with links get the least id of their component; the others have their own.
    linked = classes.join(roots, classes.bits == roots.node)
    tops = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = linked.select("bits", "root").join(tops, "root").select(F.col("bits").alias("_bits"), "component_id")
    named, _ = stored(
        classes.join(named, F.col("bits") == F.col("_bits"), "left").select(F.col("bits").alias("_bits"), F.coalesce("component_id", "_least").alias("component_id")), "simhash-names"
    )
    return marks.join(named, F.col("bits") == F.col("_bits"), "left").select(
        F.col(id_col), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` without all but the least id of each group of near-duplicates.

    An id names a document: of rows that share one, the least by text is the
    document. A row without an id stays, as nothing names it.
    """
    named = docs.where(F.col(id_col).isNotNull())
    groups = near_duplicates(named, id_col, text_col, k, radius)
    stay = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_simhash_stays")).distinct()
    rows = named.join(stay.hint("merge"), F.col(id_col) == F.col("_simhash_stays"), "left_semi")
    first = Window.partitionBy(id_col).orderBy(text_col)
    rows = rows.withColumn("_simhash_nth", F.row_number().over(first)).where("_simhash_nth = 1").drop("_simhash_nth")
    return rows.unionByName(docs.where(F.col(id_col).isNull()))
