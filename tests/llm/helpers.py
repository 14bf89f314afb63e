"""Tables for the operators' tests: every edge case in one, and plain stand-ins of what operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, tag int, list string, _id int, _text string, score string"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    stock = random.Random(0)
    names = ["".join(stock.choice("abcdefghilmnoprstu") for _ in range(stock.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(words))


def documents(spark, texts: list[tuple], langs: list | None = None):
    """Rows of (doc_id, text); the other columns hold nulls and names that operators use themselves."""
    rows = [(i, t, langs[k] if langs else None, None, None if t is None else len(t), "x", 1, "y", 7, "clash", "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, ties, odd characters, one long text."""
    passage = prose(1, 60)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, prose(2, 200)), (7, prose(2, 200)), (8, prose(2, 200) + " changed end"),
        (9, prose(3, 80) + " " + passage + " " + prose(4, 80)), (10, prose(5, 90) + " " + passage), (11, passage + "\n" + passage), (12, "ÄÖÜ ß é\u0301 日本語 \U0001f600 İ"),
        (13, prose(6, 20000)), (14, "x " * 500), (None, prose(7, 50)), (16, "no\u00a0break\x00zero\u2028line"),
    ]
