"""The corpus pipeline: language ID, near-dedup, substring dedup, packing.

Each stage takes all that its predecessor kept, as a table of documents (doc_id,
text, lang, source, n_chars), and returns such a table; the last returns where
each piece of a document is packed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attestra.llm import language, near, packing, substrings
from attestra.llm.common import drop, modest_batches, stored, table

#: Workers of several stages live side by side, so batches between them and the JVM are small.
BATCH_BYTES = 2 << 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or with a narrow margin go."""
    modest_batches(spark, BATCH_BYTES)
    return language.crossed(docs.select(*COLUMNS)).where("not rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group whose five-word shingles are alike by 0.8 and more."""
    modest_batches(spark, BATCH_BYTES)
    return near.one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur elsewhere."""
    modest_batches(spark, BATCH_BYTES)
    return substrings.deduplicated(docs.select(*COLUMNS), length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    modest_batches(spark, BATCH_BYTES)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, public_tokenizers.PATTERN, keep_tokenizer=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]

#: Not expressible: compression, hashing by bit and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is a table that the next reads."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, written = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            drop(spark, path)
        path = written
    return STAGES[-1][1](spark, docs, sf_dir)
