"""Lists, joins that check integrity, and summaries of records, files and predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_hash
from .metrics import ratio


def missing(wanted: DataFrame, present: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key no row of the other table has; null keys are missing."""
    return wanted.join(present.select(F.col(other).alias("_present")).distinct(), F.col(key) == F.col("_present"), "left_anti")


def listed(df: DataFrame, order: list[Column], limit: int | None = None, ids: DataFrame | None = None, key: str = "") -> DataFrame:
    """In order, all rows or the first ``limit``; an explicit list of ids takes the place of the table's."""
    rows = df if ids is None else df.join(ids.select(F.col(key).alias("_listed")).distinct(), F.col(key) == F.col("_listed"), "left_semi")
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def pending(attachments: DataFrame, path: str, status: str) -> DataFrame:
    """Attachments that are still to be fetched: no path, no status, or a status that is not 200."""
    return attachments.where((F.coalesce(F.col(path), F.lit("")) == "") | F.col(status).isNull() | (F.col(status) != 200))


def downloaded(attachments: DataFrame, path: str, status: str) -> DataFrame:
    return attachments.where((F.col(status) == 200) & (F.coalesce(F.col(path), F.lit("")) != ""))


def violations(**kinds: DataFrame) -> DataFrame:
    """One list of what is wrong: ``kind`` and ``item`` of every row of each table's first column."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("string").alias("item")) for kind, df in kinds.items()])


def dangling(df: DataFrame, item: str, refs: str, known: DataFrame, key: str) -> DataFrame:
    """Items and those of their references that do not exist."""
    return missing(df.select(item, F.explode(refs).alias("ref")).distinct(), known, "ref", key)


def attachment_of(images: DataFrame, attachments: DataFrame, key: str, name: str, other: str, order: str) -> DataFrame:
    """Each image's attachment of its application: the first with an equal name, else an equal stem, else one that holds the stem.

    Images and attachments meet by equal names, equal stems and equal parts, never all
    with all: an attachment is taken apart into its parts of those lengths that stems of
    its application have, and each distinct part hands on its first attachment only.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    asked = images.select(F.col(key).alias("_key"), F.col(name).alias("_name")).where("_key IS NOT NULL AND _name IS NOT NULL").distinct().withColumn("_stem", stem(F.col("_name")))
    given = attachments.select(F.col(key).alias("_key"), F.col(other).alias("attachment"), F.col(order).alias("_order")).where("_key IS NOT NULL AND attachment IS NOT NULL")
    lengths = asked.groupBy("_key").agg(F.collect_set(F.length("_stem")).alias("_lengths"))
    starts = lambda n: F.sequence(F.lit(1), F.length("attachment") - n + 1)
    parts = F.flatten(F.transform(F.filter("_lengths", lambda n: n <= F.length("attachment")), lambda n: F.transform(starts(n), lambda i: F.substring(F.col("attachment"), i, n))))
    pieces = given.join(lengths, "_key").select("_key", "attachment", "_order", F.explode(F.array_distinct(parts)).alias("_at"))

    def first(rows: DataFrame, how: int, at: str) -> DataFrame:
        found = rows.groupBy("_key", F.col(at).alias("_at")).agg(F.min(F.struct(F.lit(how).alias("how"), "_order", "attachment")).alias("b"))
        return asked.withColumn("_at", F.col("_name" if how == 1 else "_stem")).join(found, ["_key", "_at"]).select("_key", "_name", "b")

    met = first(given.withColumn("_at", F.col("attachment")), 1, "_at").unionByName(first(given.withColumn("_at", stem(F.col("attachment"))), 2, "_at")).unionByName(first(pieces, 3, "_at"))
    best = met.groupBy("_key", "_name").agg(F.min("b").alias("b"))
    return best.select(F.col("_key").alias(key), F.col("_name").alias(name), "b.attachment", "b.how")


def import_status(files: DataFrame, attachments: DataFrame, name: str, other: str) -> DataFrame:
    """Files by how many attachments have their name: ``unmatched``, ``imported`` or ``ambiguous``."""
    n = attachments.groupBy(F.col(other).alias("_name")).agg(F.count("*").alias("matches"))
    rows = files.join(n, F.col(name) == F.col("_name"), "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return rows.drop("_name").withColumn("status", F.when(F.col("matches") == 0, "unmatched").when(F.col("matches") == 1, "imported").otherwise("ambiguous"))


def best_headings(crops: DataFrame, image: str, score: str, confidence: str, engine: str, engines: list[str]) -> DataFrame:
    """The best crop of each image: score, then confidence (none counts as -1), then the engine named first."""
    rank = F.array_position(F.array(*map(F.lit, engines)), F.col(engine))
    order = F.struct(-F.col(score), -F.coalesce(F.col(confidence), F.lit(-1.0)), F.when(rank == 0, len(engines) + 1).otherwise(rank), F.col(engine))
    return crops.groupBy(image).agg(F.min_by(F.struct(engine, score, confidence), order).alias("b")).select(image, f"b.{engine}", f"b.{score}", f"b.{confidence}")


def app_decisions(apps: DataFrame, tasks: list[str], models: list[str], predictions: DataFrame, app: str, clear: str, review: str) -> DataFrame:
    """A row for each application, task and model: cleared if any crop is, else to review if any is, else flagged; without crops no heading was found."""
    frame = apps.select(app, F.explode(F.array(*map(F.lit, tasks))).alias("task")).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    said = predictions.groupBy(app, "task", "model").agg(F.bool_or(F.col("label") == clear).alias("_clear"), F.bool_or(F.col("label") == review).alias("_review"))
    decision = F.when(F.col("_clear").isNull(), "no_heading_found").when(F.col("_clear"), "cleared_expected_positive").when(F.col("_review"), "needs_review").otherwise("flagged_negative")
    return frame.join(said, [app, "task", "model"], "left").select(app, "task", "model", decision.alias("decision"))


def funnel(df: DataFrame, **steps: Column) -> DataFrame:
    """How many rows each step has, in one pass."""
    return df.agg(F.count("*").alias("selected"), *[F.count_if(c).alias(n) for n, c in steps.items()])


def distributions(df: DataFrame, split: str, *columns: str) -> DataFrame:
    """Rows by split and each of several columns, in one pass of grouping sets: ``split``, ``by``, ``value``, ``n``."""
    sets = [[F.col(split), F.col(c)] for c in columns]
    grouped = df.groupingSets(sets, F.col(split), *map(F.col, columns)).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)])
    by = reduce(lambda out, ic: F.when(F.col(f"_g{ic[0]}") == 0, ic[1]).otherwise(out), enumerate(columns), F.lit(None).cast("string"))
    value = reduce(lambda out, ic: F.when(F.col(f"_g{ic[0]}") == 0, F.col(ic[1]).cast("string")).otherwise(out), enumerate(columns), F.lit(None).cast("string"))
    return grouped.select(F.col(split).alias("split"), by.alias("by"), F.coalesce(value, F.lit("unknown")).alias("value"), "n")


def contact_sheet(df: DataFrame, kind: str, seed: str, ids: list[str], each: int, total: int) -> DataFrame:
    """Up to ``each`` rows of every kind by their hash, topped up to ``total`` from the rest by the same hash."""
    marked = df.withColumn("_mark", order_hash(seed, *[F.col(i) for i in ids]))
    first = marked.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy("_mark", *ids))).where(F.col("_n") <= each).withColumn("_n", F.lit(0))
    #: Of the rest no more can be needed than the ``total`` with the least hashes.
    rest = marked.orderBy("_mark", *ids).limit(total).withColumn("_n", F.lit(1))
    both = first.unionByName(rest).groupBy(*df.columns, "_mark").agg(F.min("_n").alias("_n"))
    return both.orderBy("_n", "_mark", *ids).limit(total).select(*df.columns)


def entity_texts(entities: DataFrame, item: str, groups: dict[str, list[str]], least: float) -> DataFrame:
    """For each field the words of its entity groups, each once, in the order they are first met, one to a line."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, g)).alias("groups")) for f, g in groups.items()])
    rows = entities.where((F.col("score") >= least) & (F.col("group") != "") & (F.col("word") != "")).withColumn("f", F.explode(fields)).where("array_contains(f.groups, group)")
    first = rows.groupBy(item, "f.field", "word").agg(F.min("position").alias("at"))
    return first.groupBy(item, "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), "\n").alias("entity_text"))


# Fields whose support by entities alone is taken.
LOWER_RISK = ["brand_name", "fanciful_name", "class_type", "country_of_origin", "applicant_or_producer"]


def entity_policies(entity_score: Column, field: Column, safe: Column, best: Column, threshold: float, soft: float) -> dict[str, Column]:
    """Decisions from an entity score beside the ensemble's (``safe``), by the name of the policy."""
    lower = field.isin(LOWER_RISK) & (entity_score >= threshold)
    return {"entities_only": entity_score >= threshold, "entities_or_safe": safe | lower, "review_safe": safe | (lower & (best >= soft))}


def examples(positives: DataFrame, negatives: DataFrame, threshold: float) -> DataFrame:
    """Scored pairs of both labels and how each came out: true or false, clear or reject."""
    rows = positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))
    said = F.col("score") >= threshold
    return rows.withColumn("outcome", F.when(said & (F.col("label") == 1), "true_clear").when(said, "false_clear").when(F.col("label") == 1, "false_reject").otherwise("true_reject"))


def positive_support(df: DataFrame, field: str, threshold: float) -> DataFrame:
    """Part of the positive examples of a field that two scores support, and by how much the second has more."""
    rows = df.where("label = 1").groupBy(field).agg(F.count("*").alias("n"), F.count_if(F.col("baseline") >= threshold).alias("base"), F.count_if(F.col("score") >= threshold).alias("own"))
    return rows.select(field, "n", ratio(F.col("base"), F.col("n")).alias("baseline_support"), ratio(F.col("own"), F.col("n")).alias("support"), ratio(F.col("own") - F.col("base"), F.col("n")).alias("delta"))


def top_nodes(nodes: DataFrame, key: str, rank: Column, order: str, most: int) -> DataFrame:
    """The ``most`` nodes of each key with the highest rank, the earlier among equals; ``place`` keeps their own order."""
    ranked = nodes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(rank.desc(), order))).where(F.col("_n") <= most).drop("_n")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def graph_summary(nodes: DataFrame, key: str) -> DataFrame:
    """Facts of each graph from its nodes' ``similarity``, ``confidence`` and ``panel``."""
    ranked = nodes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"))))
    top = lambda k: F.avg(F.when(F.col("_n") <= k, F.col("similarity")))
    capped = lambda c, most: F.least(c, F.lit(most)) / float(most)
    return ranked.groupBy(key).agg(
        F.max("similarity").alias("best"), F.round(top(3), 6).alias("top3"), F.round(top(8), 6).alias("top8"), F.max("confidence").alias("most_confident"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        capped(F.count("*"), 256).alias("size"), capped(F.count_distinct("panel"), 10).alias("panels"), capped(F.count_if(F.col("similarity") >= 0.8), 10).alias("high"),
    )


def first_reason(**reasons: Column) -> Column:
    """The name of the first condition that holds, in the order given; ``kept`` where none does."""
    out = F.lit("kept")
    for name, condition in reversed(reasons.items()):
        out = F.when(condition, name).otherwise(out)
    return out
