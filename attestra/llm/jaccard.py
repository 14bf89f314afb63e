"""Jaccard join of sets of word n-grams by rare-first prefix filtering.

Two sets whose Jaccard coefficient is at least ``percent`` share an n-gram among the
first few of each, whatever the order, if both are in the same order. Rare n-grams
come first: how often each occurs is counted over all documents in a Count-Min
sketch of fixed size, which each task fills and a tree adds up (equal counts: by
hash). The order only decides how much work there is, never the result; as a
corpus outgrows the sketch, n-grams a little more frequent than others are no longer told apart.

Documents with equal sets are one class. The prefix n-grams of classes are joined on,
under the length filter and, for each shared n-gram, the positional filter. Pairs are
made distinct with the places of their first shared n-gram; behind it, the n-grams of
both are counted by ranges of their hashes, and pairs whose ranges differ by too
much go (suffix filter). What is left is verified once by its two sets.

Classes already linked by others need no pair of their own. The members of an
n-gram's bucket first meet a few centres: those with the fewest rarer n-grams before
it, which in a group of near copies are the least changed ones and the same for
most buckets. What links so far make one has one label; members of one label are
not compared. Each round takes four times as many centres, until all pairs of unlike
labels are no more than ``FEW`` for each member; a last round compares these. So a
group of near copies costs pairs about in proportion to its members, and no link
that joins different components is lost. A large bucket is dealt in the last round as pairs of its parts.

Edge cases: null and texts without words have an empty set and are linked with
nothing; fewer words than an n-gram are one n-gram; repeated rows and rows that
share an id are each a row of the result; a null id takes part and is a
``component_id`` only where no id is known; an empty table gives no rows; extra
columns are passed by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, run_hashes, slices, stored, text_bytes, trimmed, word_hashes
from .simhash import components
from .trees import merged

SHINGLE, PERCENT, FEW = 5, 80, 4
#: Counters of the sketch (16 MB, whatever the input), and the segments it is added up in.
COUNTERS, SEGMENTS = 1 << 22, 16
#: Ranges of hashes of the suffix filter.
RANGES = 64
#: Classes of one n-gram that a task compares with each other at most.
BUCKET = 1024
_BASE = 0x9E3779B97F4A7C15


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of n-grams as sorted hashes; A-Z are lower-cased."""
    texts = [t.lower() for t in texts]
    words, counts = word_hashes(texts)
    runs = run_hashes(words, k, _BASE) if len(words) else words
    out, at = [], 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        if 0 < n < k:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(text.split()), 1)], np.uint64))
        else:
            out.append(np.unique(runs[at : at + max(n - k + 1, 0)]))
        at += n
    return out


def overlap(total: int, percent: int = PERCENT) -> int:
    """The least intersection of two sets of ``total`` elements together that link."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of so many n-grams one is shared with any set that is alike."""
    return n - -(-percent * n // 100) + 1


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents each counter's n-grams are in."""
    width = COUNTERS // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint64)
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(text_bytes(part.column("_text")), k)
                places = (np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(COUNTERS - 1)).astype(np.int64)
                np.add.at(counts, places, np.uint64(1))
        part = TaskContext.get().partitionId()
        payloads = [packed(counts[i * width : i * width + width]) for i in range(SEGMENTS)]
        del counts
        trimmed()
        yield pa.RecordBatch.from_arrays([pa.array([part] * SEGMENTS, pa.int64()), pa.array(range(SEGMENTS), pa.int32()), pa.array(payloads, pa.binary())], ["part", "segment", "payload"])

    def packed(x: np.ndarray) -> bytes:
        """Byte by byte, the low ones first, as high ones are mostly zero."""
        return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)

    def unpacked(x: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()

    def add(parts: list[bytes]) -> bytes:
        total = np.zeros(width, np.uint64)
        for p in parts:
            total += unpacked(p)
        return packed(total)

    found = merged(docs.select("_text").mapInArrow(run, "part bigint, segment int, payload binary"), add, "jaccard-sketch")
    whole = np.concatenate([unpacked(found[i]) for i in range(SEGMENTS)]) if found else np.zeros(COUNTERS, np.uint64)
    return np.minimum(whole, np.uint64((1 << 32) - 1)).astype(np.uint32)


def ranges_of(hashes: np.ndarray) -> np.ndarray:
    """How many hashes are in each of ``RANGES`` equal ranges."""
    return np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=RANGES)


def suffix_bound(a: np.ndarray, b: np.ndarray, ranges_a: np.ndarray, ranges_b: np.ndarray, i: int, j: int) -> int:
    """At most so many elements are shared, if the first shared ones are at ``i`` and ``j`` of the prefixes ``a`` and ``b``."""
    return 1 + int(np.minimum(ranges_a - ranges_of(a[: i + 1]), ranges_b - ranges_of(b[: j + 1])).sum())


def _marks(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of every row ``_id``, ``key`` (hash of its text), ``digest`` and size of its set, ``prefix`` in rare-first order, counts by ``ranges``."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(_sketch(docs, k))  # bounded by COUNTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for part in slices(batch, "_text"):
                sets = shingle_sets(text_bytes(part.column("_text")), k)
                prefixes, ranges = [], []
                for s in sets:
                    # Sorted by hash already; a stable order by frequency keeps that among equals.
                    order = np.argsort(often[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                    prefixes.append(s[order[: prefix_length(len(s), percent)]].tobytes() if len(s) else b"")
                    ranges.append(ranges_of(s).astype(np.uint32).tobytes())
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                columns = [part.column("_id"), part.column("key"), pa.array(digests, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(prefixes, pa.binary()), pa.array(ranges, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "key", "digest", "n", "prefix", "ranges"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.withColumn("key", F.xxhash64("_text")).mapInArrow(run, f"_id {kind}, key bigint, digest binary, n bigint, prefix binary, ranges binary")


def _members(classes: DataFrame) -> DataFrame:
    """``gram``, ``c``, ``n``, ``at``: a row for each n-gram of each class's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
            sizes = np.array([len(p) for p in prefixes], np.int64)
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = (np.arange(len(row)) - starts[row]).astype(np.int32)
            grams = np.concatenate([np.zeros(0, np.int64), *prefixes])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(grams), batch.column("c").take(take), batch.column("n").take(take).cast(pa.int32()), pa.array(at)], ["gram", "c", "n", "at"])

    return classes.where("n > 0").select("c", "n", "prefix").mapInArrow(run, "gram bigint, c bigint, n int, at int")


def _filters(percent: int) -> F.Column:
    """Length and positional filter of two members ``l`` and ``r`` of a bucket."""
    least = F.expr(f"({percent} * (l.n + r.n) + {99 + percent}) div {100 + percent}")
    lengths = (F.col("l.n") * 100 >= F.col("r.n") * percent) & (F.col("r.n") * 100 >= F.col("l.n") * percent)
    return lengths & (F.col("l.n") - F.col("l.at") >= least) & (F.col("r.n") - F.col("r.at") >= least)


def _paired(found: DataFrame) -> DataFrame:
    """Distinct pairs a < b with their labels, and where their first shared n-gram is in each."""
    turned = F.col("l.c") > F.col("r.c")
    pick = lambda c, x, y: F.when(turned, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}"))
    rows = found.select(*[pick(c, *sides).alias(f"{c}_{to}") for to, sides in (("a", "lr"), ("b", "rl")) for c in ("c", "label", "at")])
    pairs = rows.groupBy(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    return pairs.agg(F.min("at_a").alias("i"), F.min("at_b").alias("j"), F.min("label_a").alias("one"), F.min("label_b").alias("two"))


def _mixed(buckets: DataFrame) -> DataFrame:
    """N-grams whose members have more than one label: ``gram``, members ``k``, ``pairs`` of unlike labels."""
    each = buckets.groupBy("gram", "label").agg(F.count("*").alias("n")).groupBy("gram").agg(F.count("*").alias("labels"), F.sum("n").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("alike"))
    return each.where("labels > 1").select(F.col("gram").alias("_gram"), "k", ((F.col("k").cast("double") * F.col("k") - F.col("alike")) / 2).alias("pairs"))


def _star_pairs(buckets: DataFrame, centres: int, percent: int) -> DataFrame:
    """Each class with the centres of each of its buckets that have another label."""
    order = F.struct("at", F.xxhash64("c").alias("lot"), "c", "n", "label")
    if centres == 1:
        chosen = buckets.groupBy("gram").agg(F.min(order).alias("m")).select("gram", "m.c", "m.n", "m.at", "m.label")
    else:
        nth = F.row_number().over(Window.partitionBy("gram").orderBy("at", F.xxhash64("c"), "c"))
        chosen = buckets.withColumn("nth", nth).where(F.col("nth") <= centres).drop("nth")
    return _paired(buckets.alias("l").join(chosen.alias("r").hint("merge"), (F.col("l.gram") == F.col("r.gram")) & (F.col("l.label") != F.col("r.label")) & _filters(percent)))


def _other_pairs(buckets: DataFrame, grams: DataFrame, percent: int, bucket: int) -> DataFrame:
    """All pairs of each bucket that are of unlike labels; a large bucket as pairs of its parts."""
    sizes = grams.select(F.col("_gram"), F.ceil(F.col("k") / bucket).cast("int").alias("parts"))
    rows = buckets.join(sizes.hint("merge"), F.col("gram") == F.col("_gram")).withColumn("mine", F.pmod(F.xxhash64("c", F.lit(11)), F.col("parts").cast("long")).cast("int"))
    left = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.deal") == F.col("r.mine")) & (F.col("l.mine") == F.col("r.deal"))
    return _paired(left.alias("l").join(left.alias("r").hint("merge"), dealt & (F.col("l.c") < F.col("r.c")) & (F.col("l.label") != F.col("r.label")) & _filters(percent)))


def _unseen(pairs: DataFrame, seen: DataFrame | None) -> DataFrame:
    if seen is None:
        return pairs
    return pairs.join(seen.select(F.col("a").alias("_a"), F.col("b").alias("_b")).hint("merge"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")


def _suffixes(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the suffix filter leaves."""
    sides = [classes.select(F.col("c").alias(s), F.col("n").alias(f"n_{s}"), F.col("prefix").alias(f"prefix_{s}"), F.col("ranges").alias(f"ranges_{s}")) for s in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {f.name: batch.column(f.name).to_pylist() for f in batch.schema}
            keep = []
            for i, j, *rest in zip(of["i"], of["j"], *(of[f"{c}_{s}"] for s in "ab" for c in ("n", "prefix", "ranges")), strict=True):
                n, p, r, m, q, t = rest
                bound = suffix_bound(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), np.frombuffer(r, np.uint32).astype(np.int64), np.frombuffer(t, np.uint32).astype(np.int64), i, j)
                keep.append(bound >= overlap(n + m, percent))
            yield batch.select(["a", "b", "one", "two"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b")
    return joined.mapInArrow(run, "a bigint, b bigint, one bigint, two bigint")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The labels of pairs whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        for batch in batches:
            keep: list[bool] = []
            for part in slices(batch, "right"):
                for x, y in zip(text_bytes(part.column("left")), text_bytes(part.column("right")), strict=True):
                    if last[0] != x:
                        last = [x, shingle_sets([x], k)[0]]
                    s, t = last[1], shingle_sets([y], k)[0]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["one", "two"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])

    left, right = (texts.select(F.col("c").alias(s), F.col("_text").alias(t)) for s, t in (("a", "left"), ("b", "right")))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "one", "two", "left", "right").mapInArrow(run, "a bigint, b bigint").distinct()


def joined(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, few: int = FEW, bucket: int = BUCKET, likely: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` of every row: the least id that links of at least ``percent`` reach.

    ``likely`` may name pairs (a, b) to be verified before all others, from a table
    of classes (c) and their texts (_text): what links there needs no other pair.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    full, full_path = stored(_marks(texts, k, percent), "jaccard-marks")
    one = full.where("n > 0").groupBy("digest").agg(F.min("n").alias("n"), F.min(F.struct(F.col("_id").isNull(), "_id", "key")).alias("m"), F.min("prefix").alias("prefix"), F.min("ranges").alias("ranges"))
    classes, classes_path = stored(one.select(F.monotonically_increasing_id().alias("c"), "digest", "n", F.col("m._id").alias("_id"), "m.key", "prefix", "ranges"), "jaccard-classes")
    marks, _ = stored(full.select("_id", "digest", "n"), "jaccard-marks")
    drop(spark, full_path)

    members = _members(classes)
    shared = members.groupBy("gram").count().where("count > 1").select(F.col("gram").alias("_gram"))
    buckets, path = stored(members.join(shared.hint("merge"), F.col("gram") == F.col("_gram")).drop("_gram").withColumn("label", F.col("c")), "jaccard-buckets")
    #: The text of each class that shares anything, once.
    named = classes.join(buckets.select("c").distinct(), "c").select("c", F.col("_id").alias("_least"), F.col("key").alias("_key"))
    wanted = texts.withColumn("key", F.xxhash64("_text")).join(named.hint("merge"), F.col("_id").eqNullSafe(F.col("_least")) & (F.col("key") == F.col("_key")))
    wanted, wanted_path = stored(wanted.select("c", "_text").dropDuplicates(["c"]), "jaccard-texts")

    names, names_path = stored(buckets.select("c", "label").distinct(), "jaccard-names")
    seen, seen_paths, centres, last = None, [], 0 if likely else 1, False
    while not last:
        grams, grams_path = stored(_mixed(buckets), "jaccard-grams")
        members_left, pairs_left, largest = grams.agg(F.sum("k"), F.sum("pairs"), F.max("k")).first()
        #: One centre comes first in any case; with as many centres as members a star is all pairs.
        last = not members_left and centres > 0 or centres > 1 and (pairs_left <= few * members_left or centres >= largest)
        mixed = buckets.join(grams.select("_gram").hint("merge"), F.col("gram") == F.col("_gram")).drop("_gram")
        if centres:
            pairs = _suffixes(_unseen(_other_pairs(mixed, grams, percent, bucket) if last else _star_pairs(mixed, centres, percent), seen), classes, percent)
        else:
            pairs = likely(wanted).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct().withColumns({"one": F.col("a"), "two": F.col("b")})
        pairs, pairs_path = stored(pairs, "jaccard-pairs")
        seen_paths.append(pairs_path)
        seen = pairs if seen is None else seen.unionByName(pairs)
        links, links_path = stored(_verified(pairs, wanted, k, percent), "jaccard-links")
        roots, root_paths = components(links, "jaccard-stars")
        to = roots.select(F.col("node").alias("_node"), "root")

        def renamed(df: DataFrame, to: DataFrame = to) -> DataFrame:
            met = df.join(to.hint("merge"), F.col("label") == F.col("_node"), "left")
            return met.select(*[c for c in df.columns if c != "label"], F.coalesce("root", "label").alias("label"))

        names, new_names = stored(renamed(names), "jaccard-names")
        if not last:
            buckets, new_path = stored(renamed(mixed), "jaccard-buckets")
            drop(spark, path)
            path = new_path
        drop(spark, names_path, grams_path, links_path, *root_paths)
        names_path, centres = new_names, centres * 4 or 1
    drop(spark, path, wanted_path, *seen_paths)

    labels = names.select(F.col("c").alias("_c"), "label")
    named = classes.select("c", "digest", "_id").join(labels.hint("merge"), F.col("c") == F.col("_c"), "left").withColumn("root", F.coalesce("label", "c"))
    tops = named.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = named.join(tops.hint("merge"), "root").select(F.col("digest").alias("_digest"), "component_id")
    rows = marks.join(named.hint("merge"), (F.col("digest") == F.col("_digest")) & (F.col("n") > 0), "left")
    return rows.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
