"""Positive and negative examples of field support, what several engines score them, and what an ensemble makes of that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import tokens, word_score
from ..functions.text import stable_id
from .metrics import votes
from .sampling import negative_pairs

# How negatives come about, and the outcomes of a decision.
STRATEGY = "same_split_same_field_shuffle"


def labelled(targets: DataFrame, group: list[str], id_col: str, value: str, seed: str, per_target: int) -> DataFrame:
    """Each target as a positive of its own value, and with ``per_target`` other values of its group as negatives.

    ``candidate`` is the value that is asked for, ``source`` whose it is, ``label`` 1 or 0,
    ``nth`` 0 for the positive; ``pair_id`` names the example. Targets without an id or value are none.
    """
    known = targets.where(F.col(id_col).isNotNull() & F.col(value).isNotNull()).select(*group, id_col, F.col(value).alias("expected"))
    own = known.select("*", F.col("expected").alias("candidate"), F.col(id_col).alias("source"), F.lit(1).alias("label"), F.lit(0).alias("nth"))
    others = negative_pairs(known, group, id_col, "expected", seed, per_target)
    others = others.select(*group, id_col, "expected", F.col("candidate_expected").alias("candidate"), F.col(f"candidate_{id_col}").alias("source"), F.lit(0).alias("label"), F.col("negative").alias("nth"))
    kind = F.when(F.col("label") == 1, "positive").otherwise("negative")
    text = [F.col(c).cast("string") for c in (*group, id_col, "source", "nth")]
    return own.unionByName(others).withColumn("pair_id", stable_id(kind, *text)).withColumn("strategy", F.when(F.col("label") == 0, STRATEGY))


def in_all_engines(texts: DataFrame, engine: str, id_col: str) -> DataFrame:
    """The ids that every engine has a text of."""
    n = texts.select(engine).distinct().agg(F.count("*").alias("_engines"))
    each = texts.groupBy(id_col).agg(F.count_distinct(engine).alias("_n"))
    return each.join(F.broadcast(n), F.col("_n") == F.col("_engines")).select(id_col)  # n is one row


def engine_scores(examples: DataFrame, texts: DataFrame, engine: str, id_col: str, body: str) -> DataFrame:
    """``examples`` of ids in all engines with ``scores``, a map of each engine to the share of the candidate's words that its text of the application has.

    A text's words are taken apart once, before they meet the examples; of several
    texts of one engine the best counts.
    """
    common = in_all_engines(texts, engine, id_col)
    read = texts.join(common, id_col, "left_semi").select(F.col(id_col).alias("_id"), F.col(engine).alias("_engine"), tokens(F.col(body)).alias("_words"))
    met = examples.withColumn("_want", tokens(F.col("candidate").cast("string"))).join(read, F.col(id_col) == F.col("_id"))
    best = met.groupBy(*examples.columns, "_engine").agg(F.max(word_score(F.col("_want"), F.col("_words"))).alias("_score"))
    pairs = F.array_sort(F.collect_list(F.struct("_engine", "_score")))
    return best.groupBy(*examples.columns).agg(F.map_from_entries(pairs).alias("scores"))


def decided(scored: DataFrame, field: Column, threshold: float, high: float) -> DataFrame:
    """A row for each example and strategy: ``predicted``, ``outcome``, the best score and the engines that support it."""
    each = F.array(*[F.struct(F.lit(name).alias("strategy_name"), d.cast("int").alias("predicted")) for name, d in votes(F.col("scores"), field, threshold, high).items()])
    rows = scored.withColumn("_d", F.explode(each)).withColumns({"strategy_name": F.col("_d.strategy_name"), "predicted": F.col("_d.predicted")}).drop("_d")
    right = F.col("predicted") == F.col("label")
    outcome = F.when(right, F.when(F.col("label") == 1, "true_positive").otherwise("true_negative")).otherwise(F.when(F.col("predicted") == 1, "false_positive").otherwise("false_negative"))
    support = F.array_sort(F.map_keys(F.map_filter("scores", lambda _, s: s >= threshold)))
    best = F.round(F.coalesce(F.array_max(F.map_values("scores")), F.lit(0.0)), 2)
    return rows.withColumns({"outcome": outcome, "max_score": best, "support_count": F.size(support), "supporting_engines": F.array_join(support, ";")})
