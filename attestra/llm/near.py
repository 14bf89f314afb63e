"""Near-dedup of documents: one of each group that links of likeness 0.8 and more make, by five-word shingles.

SimHash fingerprints of five-word shingles come first: texts whose fingerprints are
equal or within four bits, found by the bit-sliced comparison, are verified by their
sets of shingles, and what is alike is one. Fingerprints so near find most copies
with few changes, but only a part of the pairs at 0.8; the exact prefix join of the
sets then compares what is not yet one, so every link is found and none is by luck of hashes.

A group is what links reach, over any number of steps; its least id stays. Pairs
below the likeness never link, whatever their fingerprints.

Edge cases: texts without words link with nothing and stay; fewer words than a
shingle are one shingle; a row without an id stays; of rows that share an id
the least by text is the document; texts of any length are taken whole; extra columns, whatever
their names, are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jaccard
from .common import stored
from .simhash import fingerprints, similar

SHINGLE, PERCENT = 5, 80


def by_fingerprints(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of classes (c) with equal fingerprints, or fingerprints within four bits: a forest over each bucket of them."""
    prints, _ = stored(fingerprints(texts, "c", "_text", k), "near-prints")
    first, _ = stored(prints.groupBy("bits").agg(F.min("c").alias("least")), "near-first")
    same = prints.join(first.withColumnRenamed("bits", "_bits").hint("merge"), F.col("bits") == F.col("_bits")).select(F.col("least").alias("a"), F.col("c").alias("b"))
    links = similar(first.select("bits"))
    ends = [first.select(F.col("bits").alias(f"_{x}"), F.col("least").alias(f"of_{x}")).hint("merge") for x in "ab"]
    near = links.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b")).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.unionByName(near)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but the least id of each group of near-duplicates."""
    named = docs.where(F.col(id_col).isNotNull())
    groups = jaccard.joined(named, id_col, text_col, k, percent, likely=lambda texts: by_fingerprints(texts, k))
    stay = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_near_stays")).distinct()
    rows = named.join(stay.hint("merge"), F.col(id_col) == F.col("_near_stays"), "left_semi")
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    rows = rows.withColumn("_near_nth", nth).where("_near_nth = 1").drop("_near_nth")
    return rows.unionByName(docs.where(F.col(id_col).isNull()))
