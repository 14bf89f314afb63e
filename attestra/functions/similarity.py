"""Similarity that has no built-in form: partial ratio and the share of common subsequences.

Both run on Arrow batches. ``partial_ratio`` compares the shorter string with
windows of the longer one by 2 * LCS / (both lengths), 0 to 100. How other
libraries break ties between windows cannot be checked here, so scores next to
a threshold are uncertain; results name the scorer that made them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import label_text


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits per character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


@lru_cache(maxsize=4096)
def partial_ratio(a: str, b: str) -> float:
    """Best similarity of the shorter string with a window of the longer, windows over its ends included."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    n, best, letters = len(a), 0.0, set(a)
    for start in range(1 - n, len(b)):
        window = b[max(0, start) : start + n]
        #: Only windows that begin and end on a character of the shorter one can be best.
        if (start > 0 and window[0] not in letters) or (start + n < len(b) and window[-1] not in letters):
            continue
        best = max(best, 200.0 * common_subsequence(a, window) / (n + len(window)))
    return best


#: Letters of the shorter text that a word of bits holds, and letters of longer ones that are measured together.
WORD, TOGETHER = 64, 1 << 17


def partial_ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    """:func:`partial_ratio` of many pairs: the windows of all of them go through the bits of the common subsequence together, letter by letter.

    Pairs whose shorter text has more than ``WORD`` letters are measured one by one.
    """
    out = np.zeros(len(pairs))
    todo: list[tuple[int, str, str]] = []
    held = 0
    for k, (a, b) in enumerate(pairs):
        if not a or not b:
            continue
        if len(a) > len(b):
            a, b = b, a
        if a in b:
            out[k] = 100.0
        elif len(a) > WORD:
            out[k] = partial_ratio(a, b)
        else:
            todo.append((k, a, b))
            held += len(b)
            if held >= TOGETHER:
                _measure(todo, out)
                todo, held = [], 0
    if todo:
        _measure(todo, out)
    return out


def _letter_bits(todo: list[tuple[int, str, str]], ends: np.ndarray) -> np.ndarray:
    """For each letter of the longer texts, one behind the other, where it is in the shorter one."""
    known: dict[str, int] = {}
    tables: list[np.ndarray] = []
    for _, a, _ in todo:
        if a not in known:
            known[a] = len(tables)
            tables.append(np.zeros(129, np.uint64))
            for i, c in enumerate(a):
                if c < "\x80":
                    tables[-1][ord(c)] |= np.uint64(1 << i)
    codes = np.frombuffer("".join(b for _, _, b in todo).encode("utf-32-le", "surrogatepass"), np.uint32)
    mine = np.repeat([known[a] for _, a, _ in todo], np.diff(ends, prepend=0))
    hits = np.stack(tables)[mine, np.minimum(codes, 128)]
    for (_, a, b), end in zip(todo, ends.tolist(), strict=True):
        if not a.isascii():
            for c in {c for c in a if c >= "\x80"}:
                hits[end - len(b) : end][codes[end - len(b) : end] == ord(c)] = sum(1 << i for i, x in enumerate(a) if x == c)
    return hits


def _measure(todo: list[tuple[int, str, str]], out: np.ndarray) -> None:
    """Put the ratios of (place, shorter, longer) into their places."""
    size, length = (np.array([len(t[i]) for t in todo]) for i in (1, 2))
    ends, windows = np.cumsum(length), size + length - 1
    hits = _letter_bits(todo, ends)
    pair = np.repeat(np.arange(len(todo)), windows)
    base, size, length = (ends - length)[pair], size[pair], length[pair]
    start = np.arange(len(pair)) - np.repeat(np.cumsum(windows) - windows, windows) + 1 - size
    first, last = np.maximum(start, 0), np.minimum(start + size, length) - 1
    # As there: only windows that begin and end on a character of the shorter one, or at an end of the longer.
    some = np.flatnonzero(((start <= 0) | (hits[base + first] != 0)) & ((start + size >= length) | (hits[base + last] != 0)))
    some = some[np.argsort((first - last)[some], kind="stable")]
    width, begin, size, pair = (last - first + 1)[some], (base + first)[some], size[some], pair[some]
    falling, full = -width, np.uint64(0xFFFFFFFFFFFFFFFF) >> (WORD - size).astype(np.uint64)
    state = full.copy()
    for step in range(int(width[0])):
        n = int(np.searchsorted(falling, -step))
        now = state[:n]
        hit = now & hits[begin[:n] + step]
        state[:n] = ((now + hit) | (now - hit)) & full[:n]
    best = np.zeros(len(todo))
    np.maximum.at(best, pair, 200.0 * (size - np.bitwise_count(state)) / (size + width))
    out[[k for k, _, _ in todo]] = best


def lcs_share(a: str, b: str) -> float:
    """Common subsequence over the length of ``b``."""
    return common_subsequence(a, b) / len(b) if a and b else 0.0


def _over_pairs(f: Callable[[str, str], float], a: Column, b: Column) -> Column:
    """A function of two texts over Arrow batches; the UDF is made where a session is at hand."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([f(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(a, b)


def partial_score(expected: Column, observed: Column) -> Column:
    return _over_pairs(partial_ratio, label_text(expected), label_text(observed))


def heading_score(line: Column) -> Column:
    """1 with the heading whole, 0.95 with both of its words, else the share of its letters that are there in order."""
    letters = F.regexp_replace(F.upper(F.coalesce(line, F.lit(""))), "[^A-Z]", "")
    both = letters.contains("GOVERNMENT") & letters.contains("WARNING")
    return F.when(letters.contains("GOVERNMENTWARNING"), 1.0).when(both, 0.95).otherwise(_over_pairs(lcs_share, F.substring(letters, 1, 25), F.lit("GOVERNMENTWARNING")))
