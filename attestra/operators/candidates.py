"""What of a panel's text is most like an expected value: blocks, runs of blocks and the text's beginning, ranked."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from ..functions.similarity import WORD, partial_ratio, partial_ratios
from ..functions.text import bound, collapsed, text
from .evaluation import windows

# How much of the whole text is a candidate, and how many candidates are kept.
BEGINNING, MOST = 1200, 18
#: Rows whose texts are measured together.
PORTION = 256
_RANKED = StructType().add("ranked", ArrayType(StructType().add("candidate", "string").add("score", "double")))


def candidates(blocks: Column, full_text: Column) -> Column:
    """Distinct texts in the order of blocks, runs of 2, 3, 5 and 8 blocks, and the beginning of the text; blank ones are none."""
    beginning = collapsed(F.substring(text(full_text), 1, BEGINNING))
    return F.array_distinct(F.filter(F.concat(windows(F.coalesce(blocks, F.array().cast("array<string>"))), F.array(beginning)), lambda c: c != ""))


class Ranker:
    """The ``most`` texts most like one expected value by partial ratio; the earlier among equals.

    The letters of the expected value are counted once. A text cannot score more than
    the letters it shares allow, so one that cannot reach the worst kept so far is not
    measured; what is kept is the same as by measuring all.
    """

    def __init__(self, expected: str):
        self.expected = expected.lower()
        self.letters = Counter(self.expected)
        self.measured = 0

    def bound(self, low: str) -> float:
        n = min(len(self.expected), len(low))
        if not n:
            return 0.0
        shared = sum(min(k, low.count(ch)) for ch, k in self.letters.items())
        # m shared letters in windows of n at most: the best is a window of just these.
        m = min(shared, n)
        return 200.0 * m / (n + m)

    def __call__(self, texts: list[str], most: int) -> list[tuple[str, float]]:
        kept: list[tuple[float, int]] = []
        for at, t in enumerate(texts):
            low = t.lower()
            if len(kept) == most and self.bound(low) <= kept[0][0]:
                continue
            self.measured += 1
            entry = (partial_ratio(self.expected, low), -at)
            if len(kept) < most:
                heapq.heappush(kept, entry)
            elif entry > kept[0]:
                heapq.heapreplace(kept, entry)
        return [(texts[-at], score) for score, at in sorted(kept, reverse=True)]


def ranked_lists(values: list[str | None], lists: list[list[str] | None], most: int) -> list[list[dict]]:
    """The ``most`` of each list nearest to its value. Values that fit a word of bits are measured together, longer ones by a :class:`Ranker` each."""
    short = [(v or "").lower() if len((v or "").lower()) <= WORD else None for v in values]
    scores = iter(partial_ratios([(v, t.lower()) for v, texts in zip(short, lists, strict=True) if v is not None for t in texts or []]).tolist())
    out = []
    for value, low, texts in zip(values, short, lists, strict=True):
        if low is None:
            best = Ranker(value)(texts or [], most)
        else:
            # A stable sort: the earlier among equals comes first.
            best = sorted([(t, next(scores)) for t in texts or []], key=lambda x: -x[1])[:most]
        out.append([{"candidate": c, "score": s} for c, s in best])
    return out


def ranked(rows: DataFrame, expected: str, found: str, most: int = MOST) -> DataFrame:
    """``rows`` with ``ranked``: the ``most`` of the array ``found`` nearest to ``expected`` by partial ratio. A null or blank value has all scores 0."""
    schema = StructType([*rows.schema.fields, *_RANKED.fields])
    arrow = to_arrow_schema(_RANKED).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in (batch.slice(i, PORTION) for i in range(0, batch.num_rows, PORTION)):
                out += ranked_lists(part.column(expected).to_pylist(), part.column(found).to_pylist(), most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*batch.schema.names, "ranked"])

    return rows.mapInArrow(run, schema)


def ranked_by(expected: Column, found: Column, score: Callable[[Column, Column], Column], most: int = MOST) -> Column:
    """The same as a column with a score that is an expression."""
    scored = bound(expected, lambda e: F.transform(found, lambda c, i: F.struct((-score(e, c)).alias("minus"), i.alias("at"), c.alias("candidate"))))
    return F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: F.struct(x["candidate"].alias("candidate"), (-x["minus"]).alias("score")))
