"""How well each field of an application is borne out by its panels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.evidence import phrase_score, words_score
from ..functions.text import bound, collapsed, label_text, label_words, text, unquoted
from ..functions.variants import field_variants
from .rules import with_parts, with_plain

#: Words of passages that go to every task at once.
BLOCK_WORDS = 500_000
#: Meetings of a document's word with a passage that a task counts at once.
MEETINGS = 1 << 21


def best_by_words(docs: DataFrame, passages: DataFrame, doc: str, have: str, item: str, want: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each passage the document that has the largest share of its distinct words, the smaller id among equals.

    Passages are taken in blocks of about ``block_words`` words, dealt by the hash of
    their ids. An index of a block's words goes to every task, which counts what its
    documents have and hands on its best document for each passage only, so
    documents are never shuffled. A passage that shares no word with any document
    gets the least of them with score 0; documents and passages without words take
    no part; a passage longer than a block is one by itself.
    """
    asked = passages.where(F.size(want) > 0).select(F.col(item).alias("item"), F.array_distinct(want).alias("words"))
    schema = f"item {asked.schema['item'].dataType.simpleString()}, doc {docs.schema[doc].dataType.simpleString()}, score double"
    item_arrow, doc_arrow = to_arrow_type(asked.schema["item"].dataType), to_arrow_type(docs.schema[doc].dataType)
    blocks = -(-(asked.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words)
    # Documents without words go out in the tasks: a filter here would be pushed below what deals documents to tasks and work out the words of all once more.
    read = docs.select(F.col(doc).alias("doc"), F.col(have).alias("have"))

    # Within this function, so that it travels with it to where this package is not installed.
    def counts(have: pa.Array, rank: np.ndarray, known: pa.Array, starts: np.ndarray, holders: np.ndarray, n: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
        """How many distinct words of each of ``n`` passages documents have, for ``step`` documents at a time in the order of ``rank``.

        ``holders`` are the passages of each ``known`` word, from its place in ``starts`` on.
        """
        words = have.flatten()
        found = pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), -1).to_numpy(zero_copy_only=False)
        whose = np.repeat(rank, pc.list_value_length(have).to_numpy(zero_copy_only=False))[found >= 0]
        whose, found = np.divmod(np.unique(whose * len(known) + found[found >= 0]), max(1, len(known)))
        many = starts[found + 1] - starts[found]
        for first in range(0, len(have), step):
            a, z = np.searchsorted(whose, [first, first + step])
            ends = np.cumsum(many[a:z])
            place = np.arange(ends[-1] if z > a else 0) + np.repeat(starts[found[a:z]] - ends + many[a:z], many[a:z])
            cell = np.repeat((whose[a:z] - first) * n, many[a:z]) + holders[place]
            yield first, np.bincount(cell, minlength=step * n).reshape(step, n)

    def scores(block: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        number = {w: i for i, w in enumerate(dict.fromkeys(w for r in rows for w in r["words"]))}
        sizes = np.array([len(r["words"]) for r in rows], np.int64)
        at = np.array([number[w] for r in rows for w in r["words"]], np.int64)
        holders = np.repeat(np.arange(len(rows)), sizes)[np.argsort(at, kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(number)))])
        sent = docs.sparkSession.sparkContext.broadcast(([r["item"] for r in rows], sizes, list(number), starts, holders))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, sizes, words, starts, holders = sent.value
            known, n, step = pa.array(words, pa.string()), len(items), max(1, MEETINGS // max(1, len(holders)))
            best, who, least = np.zeros(n, np.int64), [None] * n, None
            for batch in batches:
                batch = batch.filter(pc.greater(pc.list_value_length(batch.column("have")), 0))
                if not batch.num_rows:
                    continue
                order = pc.sort_indices(batch.column("doc")).to_numpy()
                names = batch.column("doc").take(pa.array(order)).to_pylist()
                least = names[0] if least is None else min(least, names[0])
                for first, held in counts(batch.column("have"), np.argsort(order), known, starts, holders, n, step):
                    top, row = held.max(axis=0), held.argmax(axis=0)
                    for i in np.flatnonzero((top > 0) & (top >= best)).tolist():
                        one = names[first + row[i]]
                        if top[i] > best[i] or one < who[i]:
                            best[i], who[i] = top[i], one
            if least is not None:
                who = [least if x is None else x for x in who]
                yield pa.RecordBatch.from_arrays([pa.array(items, item_arrow), pa.array(who, doc_arrow), pa.array(100.0 * best / sizes, pa.float64())], ["item", "doc", "score"])

        return read.mapInArrow(run, schema)

    every = [scores(b) for b in range(blocks)] or [docs.sparkSession.createDataFrame([], schema)]
    top = reduce(DataFrame.unionByName, every).groupBy("item").agg(F.min_by(F.struct("doc", "score"), F.struct(-F.col("score"), F.col("doc"))).alias("b"))
    return top.select(F.col("item").alias(item), F.col("b.doc").alias(doc), F.round("b.score", 6).alias("score"))


def targets(applications: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """A row for each field that is not blank: ``item``, ``field``, ``expected``."""
    long = applications.select(item, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), collapsed(F.col(f).cast("string")).alias("expected")) for f in fields])).alias("t"))
    return long.select(item, "t.field", "t.expected").where("expected <> ''")


def evaluated(wanted: DataFrame, panels: DataFrame, item: str, panel: str, body: str, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Each field's best score over its variants and the item's panels, and what follows from it.

    The first panel and variant with the best score count; with no score at all
    there is no best panel. Panels meet fields on the item; the best is a partial
    aggregate, so nothing is ranked. Without a ``score`` the share of words counts,
    for which a panel's text is made plain once, before they meet.
    """
    tried = wanted.select(item, "field", "expected", F.posexplode(field_variants(F.col("field"), F.col("expected"))).alias("variant", "candidate"))
    read = F.col(body) if score else F.concat(F.lit(" "), label_text(F.col(body)), F.lit(" "))
    tried = tried if score else tried.withColumn("_plain", label_text(F.col("candidate")))
    met = tried.join(panels.select(item, F.col(panel).alias("panel"), read.alias("read")), item)
    points = score(F.col("candidate"), F.col("read")) if score else phrase_score(F.col("_plain"), F.col("read"))
    scored = met.select(item, "field", "expected", "variant", "candidate", "panel", points.alias("score"))
    best = scored.groupBy(item, "field", "expected").agg(F.min_by(F.struct("score", "panel", "candidate"), F.struct(-F.col("score"), F.col("panel"), F.col("variant"))).alias("b"))
    return _outcomes(best, item)


def evaluated_alone(items: DataFrame, item: str, panel: str, body: str, fields: list[str]) -> DataFrame:
    """What :func:`evaluated` says of items with a single panel, which stands in their own row: nothing meets and nothing is shuffled.

    Scores are shares of words. A value that stands on the panel as it is cannot be
    outdone, so its variants are made and tried only for the others.
    """
    read = with_plain(with_parts(items, body)).withColumns({f"_expected_{f}": collapsed(F.col(f).cast("string")) for f in fields})
    first = read.withColumns({f"_given_{f}": unquoted(F.col(f"_expected_{f}")) for f in fields})
    first = first.withColumns({f"_plain_{f}": label_text(F.col(f"_given_{f}")) for f in fields})
    first = first.withColumns({f"_own_{f}": phrase_score(F.col(f"_plain_{f}"), F.col("_padded"), F.col("_cut")) for f in fields})

    def tried(f: str) -> Column:
        each = F.transform(field_variants(F.lit(f), F.col(f"_expected_{f}")), lambda c, i: F.struct(words_score(label_words(c), F.col("_padded"), F.col("_cut")).alias("score"), (-i).alias("last"), c.alias("candidate")))
        best = F.when(F.col(f"_own_{f}") == 100, F.struct(F.col(f"_own_{f}").alias("score"), F.lit(0).alias("last"), F.col(f"_given_{f}").alias("candidate"))).otherwise(F.array_max(each))
        return F.when(F.col(f"_given_{f}") != "", best)

    best = first.withColumns({f"_best_{f}": tried(f) for f in fields})
    long = best.select(item, F.col(panel).alias("panel"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_expected_{f}").alias("expected"), F.col(f"_best_{f}").alias("best")) for f in fields])).alias("t"))
    some = long.where("t.best IS NOT NULL").select(item, "t.field", "t.expected", F.struct("t.best.score", "panel", "t.best.candidate").alias("b"))
    return _outcomes(some, item)


def _outcomes(best: DataFrame, item: str) -> DataFrame:
    """What follows from the best ``b`` of a field: its score, panel and candidate."""
    points = F.col("b.score")
    return best.select(
        item, "field", "expected", F.round(points, 4).alias("score"), F.when(points > 0, F.col("b.panel")).alias("best_panel"), F.when(points > 0, F.col("b.candidate")).alias("best_candidate"),
        F.when(points >= 90, "pass").otherwise("needs_review").alias("verdict"), F.when(points >= 90, "matched").when(points >= 75, "ambiguous").otherwise("not_found").alias("outcome"),
    )


def application_verdicts(fields: DataFrame, item: str) -> DataFrame:
    """Pass if there is an actionable field and all of them pass; never a failure."""
    return fields.groupBy(item).agg(F.when(F.bool_and(F.col("verdict") == "pass"), "pass").otherwise("needs_review").alias("overall_verdict"), F.count("*").alias("fields"))


def prompt(field: Column, expected: Column, candidate: Column, product_type: Column, origin: Column, imported: Column) -> Column:
    """The text of a pair as an arbiter of field support reads it."""
    return F.concat_ws("\n", F.concat(F.lit("field: "), F.replace(field, F.lit("_"), F.lit(" "))), F.concat(F.lit("application value: "), expected), F.concat(F.lit("candidate evidence: "), candidate),
                       F.concat(F.lit("product type: "), product_type), F.concat(F.lit("origin: "), text(origin)), F.concat(F.lit("imported: "), F.when(imported, "true").otherwise("false")), F.lit("panel complexity: runtime"))


def windows(blocks: Column, widths: tuple[int, ...] = (2, 3, 5, 8)) -> Column:
    """Blocks of text and runs of neighbouring ones, distinct, shorter runs first."""
    clean = F.filter(F.transform(blocks, lambda b: collapsed(b)), lambda b: b != "")
    # Bound, as each run would else clean all blocks anew.
    return bound(clean, lambda c: F.array_distinct(F.concat(c, *[_runs(c, w) for w in widths])))


def _runs(clean: Column, width: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(clean) - width + 1, F.lit(1)))
    return F.when(F.size(clean) >= width, F.transform(starts, lambda i: F.array_join(F.slice(clean, i, width), " "))).otherwise(F.array().cast("array<string>"))
