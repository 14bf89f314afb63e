"""Quality figures from scores and labels: confusion, thresholds, latency, votes, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int | None = 4, empty: float | None = 0.0) -> Column:
    """a / b, or ``empty`` where b is zero."""
    value = a.cast("double") / b
    return F.when(b == 0, F.lit(empty)).otherwise(F.round(value, digits) if digits is not None else value)


def confusion(df: DataFrame, label: str, predicted: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Counts and rates of each group (all rows without ``by``); one partial aggregation."""
    yes, said = F.col(label).cast("boolean"), F.col(predicted).cast("boolean")
    counts = df.groupBy(*(by or [])).agg(
        F.count("*").alias("examples"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(~yes & ~said).alias("tn"), F.count_if(yes & ~said).alias("fn")
    )
    return with_rates(counts, digits)


def with_rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Rates from tp, fp, tn, fn; F1 from the unrounded precision and recall."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp, None), ratio(tp, tp + fn, None)
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn, digits), "precision": ratio(tp, tp + fp, digits), "recall": ratio(tp, tp + fn, digits),
        "specificity": ratio(tn, tn + fp, digits), "f1": F.when(p + r == 0, 0.0).otherwise(F.round(2 * p * r / (p + r), digits)), "false_clear_rate": ratio(fp, fp + tn, digits),
    })


def confusion_with_total(df: DataFrame, label: str, predicted: str, field: str, digits: int = 4) -> DataFrame:
    """Overall (``field`` is ``all``) and by field, in one pass of grouping sets."""
    yes, said = F.col(label).cast("boolean"), F.col(predicted).cast("boolean")
    sums = [F.count("*").alias("examples"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(~yes & ~said).alias("tn"), F.count_if(yes & ~said).alias("fn")]
    grouped = df.groupingSets([[F.col(field)], []], F.col(field)).agg(*sums, F.grouping(field).alias("_total"))
    named = grouped.withColumn(field, F.when(F.col("_total") == 1, "all").otherwise(F.col(field))).drop("_total")
    return with_rates(named, digits)


def multiclass(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, F1; and the macro and weighted means on each row."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = cells.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    columns = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("guessed"))
    joined = rows.join(columns, "class", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    p, r = ratio(F.col("tp"), F.col("guessed"), None), ratio(F.col("tp"), F.col("support"), None)
    out = joined.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    #: One row per class: few, whatever the number of rows counted.
    every = Window.partitionBy()
    weighted = F.sum(F.col("f1") * F.col("support")).over(every) / F.sum("support").over(every)
    return out.select("class", "support", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], F.round(F.avg("f1").over(every), 4).alias("macro_f1"), F.round(weighted, 4).alias("weighted_f1"))


def thresholds_swept(df: DataFrame, label: str, score: str) -> DataFrame:
    """Confusion counts when everything scored at least ``threshold`` is accepted, for each score present.

    Equal scores are summed up before the running sums, so the window runs over
    distinct scores only.
    """
    by_score = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label).cast("boolean")).alias("yes"), F.count_if(~F.col(label).cast("boolean")).alias("no"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = by_score.agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    swept = by_score.withColumns({"tp": F.sum("yes").over(down), "fp": F.sum("no").over(down)}).crossJoin(F.broadcast(total))
    counts = swept.select("threshold", "tp", "fp", (F.col("all_no") - F.col("fp")).alias("tn"), (F.col("all_yes") - F.col("tp")).alias("fn"))
    return with_rates(counts, 6)


def tuned_threshold(df: DataFrame, label: str, score: str, most_false_clears: float, step: float = 0.01) -> DataFrame:
    """The threshold on a grid between 0 and 1 with the best (F1, recall, specificity, threshold) under a cap of false clears.

    Where none keeps the cap: the least false clears, then F1, recall, threshold.
    Scores are first counted by grid cell, so what is swept has 1 / step rows.
    """
    n = round(1 / step)
    yes = F.col(label).cast("boolean")
    cells = df.groupBy(F.floor(F.col(score) / step + 1e-9).cast("int").alias("cell")).agg(F.count_if(yes).alias("yes"), F.count_if(~yes).alias("no"))
    grid = df.sparkSession.range(1, n).select(F.col("id").cast("int").alias("cell"), F.round(F.col("id") * step, 6).alias("threshold"))
    filled = grid.join(F.broadcast(cells), grid.cell <= cells.cell, "left").groupBy("threshold").agg(F.coalesce(F.sum("yes"), F.lit(0)).alias("tp"), F.coalesce(F.sum("no"), F.lit(0)).alias("fp"))
    total = cells.agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    counts = filled.crossJoin(F.broadcast(total)).select("threshold", "tp", "fp", (F.col("all_no") - F.col("fp")).alias("tn"), (F.col("all_yes") - F.col("tp")).alias("fn"))
    rated = with_rates(counts, 6).withColumn("allowed", F.col("false_clear_rate") <= most_false_clears)
    clears = F.when(F.col("allowed"), 0.0).otherwise(F.col("false_clear_rate"))
    specific = F.when(F.col("allowed"), F.col("specificity")).otherwise(0.0)
    return rated.orderBy(F.desc("allowed"), clears, F.desc("f1"), F.desc("recall"), specific.desc(), F.desc("threshold")).limit(1).select("threshold", "tp", "fp", "tn", "fn", "f1", "recall", "false_clear_rate", "allowed")


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, median, max and p95 by each of three definitions in use."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_times"))
    #: A row for each different value; equal ones are counted before they meet.
    upto = Window.partitionBy(*by).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"_upto": F.sum("_times").over(upto), "_n": F.sum("_times").over(Window.partitionBy(*by))})

    def at(place: Column) -> Column:
        """The value at a place counted from zero in the order of values."""
        return F.min(F.when(F.col("_upto") > place, F.col("_value")))

    n, point = F.col("_n"), 0.95 * (F.col("_n") - 1)
    found = ranked.groupBy(*by).agg(
        F.sum("_times").alias("n"), (F.sum(F.col("_value") * F.col("_times")) / F.sum("_times")).alias("_mean"), at(F.floor((n - 1) / 2)).alias("_low"), at(F.ceil((n - 1) / 2)).alias("_high"), F.max("_value").alias("most"),
        at(F.least(n - 1, F.floor(n * 0.95))).alias("p95_floor"), at(F.bround(point)).alias("p95_round"), at(F.floor(point)).alias("_below"), at(F.ceil(point)).alias("_above"), F.max(point - F.floor(point)).alias("_part"),
    )
    return found.select(
        *by, "n", F.round("_mean", 2).alias("mean"), F.round((F.col("_low") + F.col("_high")) / 2, 2).alias("median"), "most", "p95_floor", "p95_round",
        F.round(F.col("_below") + F.col("_part") * (F.col("_above") - F.col("_below")), 4).alias("p95_linear"),
    )


# Fields by how much agreement they need.
ALL_ENGINES_FIELD = "alcohol_content"
SINGLE_ENGINE_FIELDS = ["brand_name", "fanciful_name", "country_of_origin", "net_contents"]
CAUTIOUS_ENGINE = "paddleocr"


def votes(scores: Column, field: Column, threshold: float, high: float) -> dict[str, Column]:
    """Decisions of an ensemble from a map of engine to score, by the name of the strategy."""
    values = F.map_values(scores)
    support = F.size(F.filter(values, lambda x: x >= threshold))
    n, best, two = F.size(values), F.coalesce(F.array_max(values), F.lit(0.0)), F.size(F.filter(values, lambda x: x >= threshold)) >= 2
    lone = (field == ALL_ENGINES_FIELD) & (best_engine(scores) == CAUTIOUS_ENGINE)
    return {
        "any": best >= threshold, "majority": two, "unanimous": support == n, "high_or_majority": two | (best >= high),
        "safety_weighted": two | ((best >= high) & ~lone),
        "government_safe": F.when(field == ALL_ENGINES_FIELD, support == n).otherwise(two | (field.isin(SINGLE_ENGINE_FIELDS) & (best >= high))),
    }


def best_engine(scores: Column) -> Column:
    """The engine with the highest score, the first by name among equals."""
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    return F.try_element_at(ranked, F.lit(1))["k"]


def soft_vote(df: DataFrame, key: list[str], label: str, probability: str) -> DataFrame:
    """The class with the highest mean probability over models; the first by name among equals."""
    means = df.groupBy(*key, label).agg(F.avg(probability).alias("p"))
    return means.groupBy(*key).agg(F.min_by(F.col(label), F.struct(-F.col("p"), F.col(label))).alias("predicted"))


def positive_reject(df: DataFrame, key: list[str], label: str, probability: str, positive: str, review: str, threshold: float) -> DataFrame:
    """The most probable class of each key, the first by name among equals; a positive one that is less probable than ``threshold`` goes to review."""
    best = df.groupBy(*key).agg(F.min_by(F.struct(F.col(label).alias("c"), F.col(probability).alias("p")), F.struct(-F.col(probability), F.col(label))).alias("_b"))
    weak = (F.col("_b.c") == positive) & (F.col("_b.p") < threshold)
    return best.select(*key, F.when(weak, review).otherwise(F.col("_b.c")).alias("predicted"))


def strict_veto(df: DataFrame, key: list[str], predicted: str, review: str) -> DataFrame:
    """What all models say, else review."""
    return df.groupBy(*key).agg(F.when(F.count_distinct(predicted) == 1, F.min(predicted)).otherwise(review).alias("predicted"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies with mean one."""
    inverse = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("w", 1.0 / F.col("n"))
    return inverse.select(label, "n", F.round(F.col("w") / F.avg("w").over(Window.partitionBy()), 6).alias("weight"))


def field_summary(df: DataFrame, by: str) -> DataFrame:
    """Attempted, matched and doubtful fields, their match rate and mean score; null rates where nothing was tried."""
    tried = F.col("outcome") != "not_applicable"
    n, hit = F.count_if(tried), F.count_if(F.col("outcome") == "matched")
    return df.groupBy(by).agg(
        n.alias("attempted"), hit.alias("matched"), F.count_if(tried & (F.col("verdict") == "needs_review")).alias("needs_review"),
        F.round(hit / F.nullif(n, F.lit(0)), 4).alias("match_rate"), F.round(F.avg(F.when(tried, F.col("score"))), 2).alias("mean_score"),
    )


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys, ``unknown`` where a key is null or blank."""
    named = df.select(*[F.coalesce(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")), F.lit("unknown")).alias(k) for k in keys])
    return named.groupBy(*keys).agg(F.count("*").alias("n"))
