"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts up to ``ORDER``, kept as one hash table of
n-grams per order (an n-gram is its bytes, packed into 64 bits). A byte is coded
at the longest context in the trie that has seen it; each context that has not
is left by an escape (method D: half a count for every symbol seen), and what
it has seen is excluded at the shorter ones. What a context leaves at the next
shorter one depends on that context alone, so it is worked out once when the
trie is built.

Counts come from all training texts, added up in the tasks, then by one
shuffle, and every n-gram counts: the model grows with the texts and is never
in one place. A symbol's probability depends on its longest n-gram alone, and
all that this needs beyond order 1 is in contexts that end with the same two
bytes. So the n-grams of the training texts and of the texts to score are dealt
by these two bytes; a task builds the tries of its share, with the at most 2^16
n-grams of orders 0 and 1 beside them, and gives each n-gram its probability.
Texts end with a byte that UTF-8 has not (0xFF), which also pads the first
contexts.

The unigram base score needs the count of every word of every text. The
probabilities of the ``COMMON`` n-grams and the counts of the ``HEADS`` words
that occur most often are broadcast; all others are joined, n-grams as they
are and words by their 64-bit hash, one row for each of a document. How many
are broadcast has no effect on a score.

Edge cases: a null or empty text is the end alone; without training texts every
byte is equally likely and no word is known; repeated rows get equal scores; a
null id's fold is that of the empty string; extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, partitions, slices, stored, text_bytes

ORDER, COMMON, HEADS = 5, 1 << 20, 1 << 17
#: A task builds tries of about so many n-grams at once.
SHARE = 1 << 18
END = 0xFF
#: Stands for the end among the words; no word has a space.
END_WORD = xxhash.xxh3_64_intdigest(b" ")
_GAP, _SPREAD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


def lowered(column: pa.Array) -> list[bytes]:
    return [t.lower() for t in text_bytes(column)]


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with the ``order`` bytes before it, packed; and each text's number of symbols."""
    pad = bytes([END]) * order
    raw = np.frombuffer(b"".join(pad + t for t in texts) + bytes([END]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    keys = raw.astype(np.uint64)
    wide = keys.copy()
    for back in range(1, order + 1):
        keys[back:] |= wide[:-back] << np.uint64(8 * back)
    real = raw != END
    real[np.cumsum(sizes - 1 + order)] = True
    return keys[real], sizes


class Lookup:
    """Places of keys in an array, by open addressing; the keys use less than 64 bits."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.place = np.full(1 << self.bits, _GAP), np.zeros(1 << self.bits, np.int32)
        wait, slot = np.arange(len(keys)), self.slots(keys)
        while len(wait):
            free = np.flatnonzero(self.keys[slot] == _GAP)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.place[slot[first]] = keys[wait[first]], wait[first]
            wait, slot = np.delete(wait, first), (np.delete(slot, first) + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is none."""
        slot = self.slots(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.place[slot], -1)
        more = np.flatnonzero((seen != keys) & (seen != _GAP))
        slot, keys = slot[more], keys[more]
        while len(more):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot]
            hit = seen == keys
            out[more[hit]] = self.place[slot[hit]]
            on = np.flatnonzero(~hit & (seen != _GAP))
            more, slot, keys = more[on], slot[on], keys[on]
        return out


class Trie:
    """From the n-grams and counts of each order; those of an order end those of the next."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        before = None
        for order, (keys, counts) in enumerate(levels):
            keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
            contexts, row = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(row, counts, len(contexts)), np.bincount(row, minlength=len(contexts)).astype(np.float64)
            level = {"grams": Lookup(keys), "n": counts.astype(np.float32), "contexts": Lookup(contexts), "total": total, "kinds": kinds}
            if before is not None and len(keys):
                grams, n, heads, totals, kinds_below = before
                below = grams.find(keys & _mask(order))
                under = heads.find(contexts & _mask(order - 1))
                level["rest"] = totals[under] - np.bincount(row, n[below], len(contexts))
                level["rest_kinds"] = kinds_below[under] - kinds
            self.levels.append(level)
            before = level["grams"], counts, level["contexts"], total, kinds

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 of the probability of each packed symbol after its context."""
        out = np.zeros(len(keys))
        at, total, kinds = np.arange(len(keys)), None, None
        for order in reversed(range(len(self.levels))):
            if not len(at):
                return out
            level = self.levels[order]
            if not len(level["total"]):
                continue
            here = keys[at] & _mask(order + 1)
            gram = level["grams"].find(here)
            context = level["contexts"].find(here >> np.uint64(8))
            known = context >= 0
            own_total, own_kinds = np.where(known, level["total"][context], 0), np.where(known, level["kinds"][context], 0)
            if total is not None:
                own_total, own_kinds = np.where(total >= 0, total, own_total), np.where(total >= 0, kinds, own_kinds)
            hit = gram >= 0
            out[at[hit]] += np.log2((2 * level["n"][gram[hit]] - 1) / (2 * own_total[hit]))
            miss = np.flatnonzero(~hit)
            leave = miss[known[miss] & (own_total[miss] > 0)]
            out[at[leave]] += np.log2(own_kinds[leave] / (2 * own_total[leave]))
            if order:
                total = np.where(known[miss], level["rest"][context[miss]], -1.0) if "rest" in level else np.full(len(miss), -1.0)
                kinds = np.where(known[miss], level["rest_kinds"][context[miss]], 0) if "rest" in level else np.zeros(len(miss))
            at = at[miss]
        root = self.levels[0]["kinds"] if self.levels else np.zeros(0)
        out[at] -= np.log2(256 - (root[0] if len(root) else 0))
        return out


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys, first = np.unique(keys[order], return_index=True)
    return keys, np.add.reduceat(np.concatenate([c for _, c in parts])[order], first) if len(keys) else np.zeros(0, np.int64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and how many they are."""
    hasher = xxhash.xxh3_64_intdigest
    lists = [t.split() for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
    out = np.full(int(sizes.sum()), END_WORD, np.uint64)
    words = np.ones(len(out), bool)
    words[np.cumsum(sizes) - 1] = False
    out[words] = np.fromiter((hasher(w) for x in lists for w in x), np.uint64, int(sizes.sum()) - len(lists))
    return out, sizes


def counts(uses: DataFrame, order: int = ORDER, pending: int = 1 << 20) -> DataFrame:
    """``kind`` (0: words, 1: n-grams), ``key``, ``n`` (in training texts) and ``asked`` (in texts to score) over all ``_text``.

    ``_use`` is 1 for a training text, 2 for one to score, 3 for both; words
    are counted in training texts only. A task adds up until it holds
    ``pending`` different keys of a kind and use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def out(kind: int, use: int) -> Iterator[pa.RecordBatch]:
            keys, n = held.pop((kind, use))[0]
            none = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64) if use & 1 else none), pa.array(n.astype(np.int64) if use & 2 else none)],
                ["kind", "key", "n", "asked"])

        for batch in batches:
            for part in slices(batch, "_text"):
                texts, marks = lowered(part.column("_text")), part.column("_use").to_numpy()
                for use in np.unique(marks).tolist():
                    mine = [texts[i] for i in np.flatnonzero(marks == use).tolist()]
                    for kind in (0, 1) if use & 1 else (1,):
                        parts = held.setdefault((kind, use), [])
                        parts.append(_counted(grams(mine, order)[0] if kind else words_of(mine)[0]))
                        if len(parts) == 4:
                            parts[:] = [_merged(parts)]
                            if len(parts[0][0]) > pending:
                                yield from out(kind, use)
        for kind, use in list(held):
            held[kind, use] = [_merged(held[kind, use])]
            yield from out(kind, use)

    added = uses.select("_text", "_use").mapInArrow(run, "kind tinyint, key bigint, n bigint, asked bigint")
    return added.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))


def _thresholds(df: DataFrame, group: str, most: int) -> dict[int, int]:
    """For each group the least count that no more than ``most`` keys have."""
    steps = sorted({round(2 ** (i / 4)) for i in range(120)})
    sums = df.groupBy(group).agg(*[F.sum((F.col("n") >= t).cast("long")).alias(f"t{t}") for t in steps]).collect()
    return {r[group]: next((t for t in steps if r[f"t{t}"] <= most), steps[-1]) for r in sums}


def _level(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return _merged([(keys & _mask(order + 1), counts)])


def probabilities(stats: DataFrame, order: int = ORDER, share: int = SHARE) -> DataFrame:
    """``key``, ``asked`` and ``value`` (log10 of the probability) of every n-gram (kind 1) of :func:`counts` that texts to score have.

    N-grams whose contexts end with the same two bytes lie together, so a task
    has all that its contexts of order 2 and more have seen.
    """
    spark = stats.sparkSession
    ngrams = stats.where("kind = 1").select("key", "n", "asked")
    short = min(1, order)
    low = ngrams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(int(_mask(short + 1)))).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low_keys, low_n = low["key"].to_numpy().view(np.uint64), low["n"].to_numpy()
    shard = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [_level(low_keys, low_n, o) for o in range(short + 1)]

        def solved(keys: np.ndarray, n: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
            seen, want = n > 0, asked > 0
            trie = Trie([base[o] if o <= short else _level(keys[seen], n[seen], o) for o in range(order + 1)])
            if want.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[want].view(np.int64)), pa.array(asked[want]), pa.array(trie.log2(keys[want]) * np.log10(2))], ["key", "asked", "value"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy(), batch.column("asked").to_numpy()])
            if sum(len(h[0]) for h in held) > share:
                now = [np.concatenate(x) for x in zip(*held, strict=True)]
                ends = (now[0] >> np.uint64(8)) & np.uint64(0xFFFF)
                #: The last two bytes' n-grams may go on in the next batch.
                cut = int(np.flatnonzero(ends != ends[-1])[-1]) + 1 if (ends != ends[-1]).any() else 0
                held = [[x[cut:] for x in now]]
                if cut:
                    yield from solved(*(x[:cut] for x in now))
        if held:
            yield from solved(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = ngrams.withColumn("_ends", shard).repartition(partitions(spark), "_ends").sortWithinPartitions("_ends")
    return dealt.select("key", "n", "asked").mapInArrow(run, "key bigint, asked bigint, value double")


def scored(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), order: int = ORDER, common: int = COMMON, heads: int = HEADS) -> DataFrame:
    """Scores of every row of ``docs`` by models of ``train``'s texts; ``keep`` names columns that go along."""
    uses = [df.select(F.col(text_col).alias("_text"), F.lit(use).alias("_use")) for df, use in ((train, 1), (docs, 2))]
    return _scored(docs, uses[0].unionByName(uses[1]), id_col, text_col, keep, order, common, heads)


def _scored(docs: DataFrame, uses: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], order: int = ORDER, common: int = COMMON, heads: int = HEADS) -> DataFrame:
    """:func:`scored`, where ``uses`` are the texts and uses of :func:`counts`; all of ``docs`` are to score there."""
    spark = docs.sparkSession
    stats, _ = stored(counts(uses, order), "counts")
    ngrams, _ = stored(probabilities(stats, order), "ngrams")
    words = stats.where("kind = 0").select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _thresholds(words.withColumn("all", F.lit(0)), "all", heads).get(0, 1)
    top = words.where(F.col("n") >= least).toArrow().sort_by("key")
    top_keys, top_n = top["key"].to_numpy(), top["n"].to_numpy()
    least = _thresholds(ngrams.select(F.col("asked").alias("n"), F.lit(0).alias("all")), "all", common).get(0, 1)
    often = ngrams.where(F.col("asked") >= least).select("key", "value").toArrow()
    model = spark.sparkContext.broadcast((Lookup(often["key"].to_numpy().view(np.uint64)), np.append(often["value"].to_numpy(), 0.0), top_keys, np.append(top_n, 0)))
    del often

    def tail(keys: np.ndarray, rows: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
        """Each row's different keys: row, kind, key and how often."""
        by = np.lexsort((keys, rows))
        rows, keys = rows[by], keys[by]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])])) if len(rows) else np.zeros(0, np.int64)
        return rows[new], np.full(len(new), kind, np.int8), keys[new], np.diff(np.append(new, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, values, top_keys, top_n = model.value
        for batch in batches:
            for part in slices(batch, "_text", 1 << 21):
                texts = lowered(part.column("_text"))
                keys, sizes = grams(texts, order)
                place = lookup.find(keys)
                score = np.add.reduceat(values[place], np.cumsum(sizes) - sizes)
                rare = np.flatnonzero(place < 0)
                tails = [tail(keys[rare].view(np.int64), np.repeat(np.arange(len(texts)), sizes)[rare], 1)]
                del keys, place
                hashes, n_words = words_of(texts)
                signed = hashes.view(np.int64)
                place = np.searchsorted(top_keys, signed)
                place[place == len(top_keys)] = 0
                head = top_keys[place] == signed if len(top_keys) else np.zeros(len(signed), bool)
                first = np.cumsum(n_words) - n_words
                logs = np.where(head, np.log10(top_n[place] + 0.5), 0.0)
                known = np.add.reduceat(head.astype(np.int64), first)
                rare = np.flatnonzero(~head)
                tails.append(tail(signed[rare], np.repeat(np.arange(len(texts)), n_words)[rare], 0))
                doc, kind, key, times = (np.concatenate(x) for x in zip(*tails, strict=True))
                by = np.argsort(doc, kind="stable")
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32))
                left = pa.StructArray.from_arrays([pa.array(kind[by]), pa.array(key[by]), pa.array(times[by].astype(np.int64))], ["kind", "key", "times"])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(n_words), pa.array(known), pa.array(np.add.reduceat(logs, first)), pa.array(score), pa.ListArray.from_arrays(offsets, left)],
                    [*others, "n_tokens", "n_known", "logs", "score", "tail"])

    others = [id_col, *keep]
    rows = docs.select(*others, F.col(text_col).alias("_text"))
    kinds_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    rows = rows.mapInArrow(run, f"{kinds_of}, n_tokens bigint, n_known bigint, logs double, score double, tail array<struct<kind:tinyint,key:bigint,times:bigint>>")
    rows, _ = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "scores")

    tails = rows.select("_row", F.explode("tail").alias("t")).select("_row", "t.kind", "t.key", "t.times")
    worth = words.select(F.lit(0).cast("tinyint").alias("_kind"), F.col("key").alias("_key"), F.log10(F.col("n") + 0.5).alias("value"))
    worth = worth.unionByName(ngrams.where(F.col("asked") < least).select(F.lit(1).cast("tinyint").alias("_kind"), F.col("key").alias("_key"), "value"))
    met = tails.join(worth.hint("merge"), (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")), "left")
    is_word = F.col("kind") == 0
    met = met.groupBy("_row").agg(
        F.sum(F.when(is_word, F.col("times") * F.coalesce("value", F.log10(F.lit(0.5))))).alias("_logs"), F.sum(F.when(is_word & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.when(~is_word, F.col("times") * F.col("value"))).alias("_score"),
    )
    all_words = F.log10(F.lit(float(total)) + 0.5 * (kinds + 1))
    return rows.drop("tail").join(met.withColumnRenamed("_row", "_tail_row"), F.col("_row") == F.col("_tail_row"), "left").select(
        *others, "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * all_words).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, part: int = 1) -> DataFrame:
    """:func:`scored` with models of the rows outside one fold of ``parts``, which is ``held_out``."""
    marked = docs.select(id_col, text_col, (crc_fold(id_col, parts) == part).alias("held_out"))
    uses = marked.select(F.col(text_col).alias("_text"), F.when(F.col("held_out"), 2).otherwise(3).alias("_use"))
    return _scored(marked, uses, id_col, text_col, ("held_out",))
