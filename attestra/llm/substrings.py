"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: among the ``SEED``-word runs of any window, the one
with the least hash. Equal windows choose equal anchors at equal places, so a
window can repeat only where its anchor does, and documents need only be joined
on anchors. An anchor is extended both ways as far as any window round it
reaches (its *context*). Anchors whose whole context occurs again belong to a
longer repeat and need no more comparison; elsewhere the maximal repeat ends
inside the context, and the windows round the anchor are compared one by one,
one document standing for all that share a context. What is left of a document
is what no repeated window covers.

Passes over the text: one for the anchors, one for the windows of the few
anchors in doubt, one that cuts. The text is shuffled by document for each of
the latter two. Counts are pre-aggregated before they move; joins on anchors
are plain equi-joins with one row per key on one side, so a hot anchor's rows
are split at run time. No pairs of documents are ever made.

Words and runs are told apart by two independent 64-bit hashes (anchor and
window or context together make 128 bits).

Edge cases: a null or empty text has no words and keeps the hash of the empty
string; texts shorter than a window keep all; repeated rows are each other's
copies and lose all that a window covers; a null id is an id; extra columns
are passed by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, run_hashes, slices, stored, text_bytes, word_hashes

WINDOW, SEED = 35, 8
_SEED_BASE, _WINDOW_BASE, _CONTEXT_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_ROW = np.uint64((1 << 24) - 1)


class Anchors:
    """The windows of some texts and their anchors, as positions in the texts' words laid end to end."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, seed: int = SEED):
        self.window, self.seed = window, seed
        self.words, self.counts = word_hashes(texts)
        n = len(self.words)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.seeds = run_hashes(self.words, seed, _SEED_BASE)
        #: Starts of all windows, and where each one's anchor begins.
        fits = np.arange(n) + window <= self.ends[self.doc] if n else np.zeros(0, bool)
        self.windows = np.flatnonzero(fits)
        #: The upper bits decide, then the earlier place; a longer text's places have an array of their own.
        apart = n > int(_ROW) + 1
        best, place = self.seeds & ~_ROW, np.arange(n, dtype=np.uint64)
        if not apart:
            best |= place
        width, length = window - seed + 1, 1
        while length < width:
            step = min(length, width - length)
            if apart:
                place[: n - step] = np.where(best[step:] < best[: n - step], place[step:], place[: n - step])
            best[: max(n - step, 0)] = np.minimum(best[: max(n - step, 0)], best[step:])
            length += step
        self.anchor = (place if apart else best & _ROW)[self.windows].astype(np.int64)
        self.anchors = np.unique(self.anchor)

    def contexts(self) -> np.ndarray:
        """A hash of all words of the windows round each anchor and of where the document ends."""
        doc = self.doc[self.anchors]
        first = np.maximum(self.starts[doc], self.anchors - (self.window - self.seed))
        last = np.minimum(self.ends[doc], self.anchors + self.window)
        prefix = np.zeros(len(self.words) + 1, np.uint64)
        powers = np.full(len(self.words) + 1, np.uint64(_CONTEXT_BASE), np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        inverse = np.full(len(self.words) + 1, np.uint64(pow(_CONTEXT_BASE, -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        np.cumsum(self.words * powers[:-1], out=prefix[1:], dtype=np.uint64)
        value = (prefix[last] - prefix[first]) * inverse[first]
        shape = ((self.anchors - first) * 256 + (last - self.anchors)).astype(np.uint64)
        return value ^ (shape * np.uint64(_WINDOW_BASE))


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return text_bytes(part.column("text"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``own`` (the id), ``text`` and the key ``id``, ``tag``, which has no nulls.

    The tag, of 64 bits, tells apart rows that share an id but not a text, and null ids.
    """
    own, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(own, F.lit("0").cast(docs.schema[id_col].dataType))
    return docs.select(own.alias("own"), text.alias("text"), key.alias("id"), F.xxhash64(text, own.isNull()).alias("tag"), *[F.col(c).alias(f"_kept_{c}") for c in keep])


def _per_document(rows: DataFrame, docs: DataFrame, value: str, how: str) -> DataFrame:
    """``docs`` with a list, per document, of the ``value`` columns' structs in ``rows``."""
    lists = rows.groupBy("id", "tag").agg(F.collect_set(F.expr(value)).alias("list"))
    return docs.join(lists.hint("merge"), ["id", "tag"], how)


def _mapped(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield from f(part)

    return run


def _lists(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Row of each struct in a column of lists, and its fields; null lists are empty."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column)
    return np.repeat(np.arange(len(sizes)), sizes), *(flat.field(flat.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's ``id_col``, ``text``, ``n_words`` and ``cover``: the spans [from, to) of words that repeated windows cover.

    Columns named in ``keep`` go along, their names led by ``_kept_``.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    id_type = keyed.schema["id"].dataType.simpleString()

    def anchors(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a = Anchors(_texts(part), window, seed)
        doc = a.doc[a.anchors]
        yield pa.RecordBatch.from_arrays(
            [part.column("id").take(pa.array(doc)), part.column("tag").take(pa.array(doc)), pa.array((a.anchors - a.starts[doc]).astype(np.int32)),
             pa.array(a.seeds[a.anchors].view(np.int64)), pa.array(a.contexts().view(np.int64))], ["id", "tag", "at", "anchor", "context"])

    found, found_path = stored(keyed.mapInArrow(_mapped(anchors), f"id {id_type}, tag bigint, at int, anchor bigint, context bigint"), "anchors")
    #: Stored, so that both sides of the join are plain exchanges, whose hot keys are split at run time.
    twice, twice_path = stored(found.groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("_anchor")), "repeated-anchors")
    seeds, seeds_path = stored(found.join(twice.hint("merge"), F.col("anchor") == F.col("_anchor")).drop("_anchor"), "seeds")
    drop(spark, found_path, twice_path)

    #: One row for each context of an anchor; the anchor is in doubt if some context occurs once.
    classes = seeds.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "tag", "at")).alias("one"))
    classes, classes_path = stored(classes, "contexts")
    doubt, _ = stored(classes.groupBy("anchor").agg(F.min("n").alias("least")).where("least = 1").select(F.col("anchor").alias("_anchor")), "anchors-in-doubt")
    doubtful = classes.join(doubt.hint("merge"), F.col("anchor") == F.col("_anchor")).select("one.id", "one.tag", "one.at", "anchor")
    whole = classes.where("n > 1").select(F.col("anchor").alias("_anchor"), F.col("context").alias("_context"))
    sure = seeds.join(whole.hint("merge"), (F.col("anchor") == F.col("_anchor")) & (F.col("context") == F.col("_context"))).select("id", "tag", "at")

    def windows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a = Anchors(_texts(part), window, seed)
        row, at = _lists(part.column("list"), "at")
        wanted = np.isin(a.anchor, at + a.starts[row])
        start = a.windows[wanted]
        doc = a.doc[start]
        hashes = run_hashes(a.words, window, _WINDOW_BASE)[start]
        yield pa.RecordBatch.from_arrays(
            [part.column("id").take(pa.array(doc)), part.column("tag").take(pa.array(doc)), pa.array((start - a.starts[doc]).astype(np.int32)),
             pa.array(a.seeds[a.anchor[wanted]].view(np.int64)), pa.array(hashes.view(np.int64))], ["id", "tag", "start", "anchor", "window"])

    compared = _per_document(doubtful, keyed, "struct(at)", "inner").mapInArrow(_mapped(windows), f"id {id_type}, tag bigint, start int, anchor bigint, window bigint")
    compared, compared_path = stored(compared, "windows")
    again, _ = stored(compared.groupBy("anchor", "window").count().where("count > 1").select(F.col("anchor").alias("_anchor"), F.col("window").alias("_window")), "repeated-windows")
    hit = compared.join(again.hint("merge"), (F.col("anchor") == F.col("_anchor")) & (F.col("window") == F.col("_window"))).select("id", "tag", F.col("start").alias("at"))
    marks = sure.withColumn("kind", F.lit(0)).unionByName(hit.withColumn("kind", F.lit(1)))

    def cut(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a = Anchors(_texts(part), window, seed)
        row, at, kind = _lists(part.column("list"), "at", "kind")
        place = at + a.starts[row]
        start = np.union1d(a.windows[np.isin(a.anchor, place[kind == 0])], place[kind == 1])
        edge = np.zeros(len(a.words) + 1, np.int32)
        edge[start] += 1
        np.add.at(edge, start + window, -1)
        covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        #: Windows keep to their document, but spans of two documents may touch.
        change = covered[1:] != covered[:-1]
        inner = a.starts[a.counts > 0]
        both = inner[(inner > 0) & covered[inner] & covered[inner + 1]]
        first = np.union1d(np.flatnonzero(change & covered[1:]), both)
        last = np.union1d(np.flatnonzero(change & covered[:-1]), both)
        doc = a.doc[first]
        sizes = np.bincount(doc, minlength=part.num_rows)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        spans = pa.StructArray.from_arrays([pa.array((x - a.starts[doc]).astype(np.int32)) for x in (first, last)], ["from", "to"])
        yield pa.RecordBatch.from_arrays([part.column("own"), part.column("text"), pa.array(a.counts), pa.ListArray.from_arrays(offsets, spans), *map(part.column, kept)], ["own", "text", "n_words", "cover", *kept])

    rows = _keyed(docs, id_col, text_col, keep)
    kept = [f"_kept_{c}" for c in keep]
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    out = _per_document(marks, rows, "struct(at, kind)", "left")
    out = out.mapInArrow(_mapped(cut), f"own {id_type}, text string, n_words bigint, cover array<struct<from:int,to:int>>{kinds}")
    return out.withColumnRenamed("own", id_col)


def kept_words(text: bytes, cover: list[dict]) -> tuple[bytes, int]:
    """A text's words outside the spans, joined by one space, and how many went."""
    words, gone = text.split(), 0
    for span in reversed(cover):
        del words[span["from"] : span["to"]]
        gone += span["to"] - span["from"]
    return b" ".join(words), gone


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def kept_text(text: bytes, cover: list[dict]) -> bytes:
    """A text without the spans; what stays keeps its white space, one space stands for a span."""
    if not cover:
        return text
    words, parts, at = [m.span() for m in _WORD.finditer(text)], [], 0
    for span in cover:
        parts.append(text[at : words[span["from"]][0]])
        at = words[span["to"] - 1][1]
    return b" ".join([p for p in (p.strip() for p in [*parts, text[at:]]) if p])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs``, column for column, with the texts that are left, and their number of characters in ``length_col``."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col, length_col))
    covered = repeats(docs, id_col, text_col, window, seed, others)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [kept_text(t, c) for t, c in zip(_texts(part), part.column("cover").to_pylist(), strict=True)]
        left = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([part.column("_own"), left, *(part.column(f"_kept_{c}") for c in others)], ["_own", "text", *(f"_kept_{c}" for c in others)])

    covered = covered.withColumnRenamed(id_col, "_own")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in covered.schema if f.name not in ("n_words", "cover"))
    out = covered.mapInArrow(_mapped(run), kinds)
    columns = {id_col: F.col("_own"), text_col: F.col("text"), **{c: F.col(f"_kept_{c}") for c in others}}
    if length_col:
        columns[length_col] = F.length("text").cast(docs.schema[length_col].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def digests(covered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``n_words``, ``n_removed`` and ``kept_sha256`` from what :func:`repeats` returns."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        removed, shas = [], []
        for text, cover in zip(_texts(part), part.column("cover").to_pylist(), strict=True):
            kept, gone = kept_words(text, cover)
            removed.append(gone)
            shas.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"])

    kind = covered.schema[id_col].dataType.simpleString()
    return covered.mapInArrow(_mapped(run), f"{id_col} {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
