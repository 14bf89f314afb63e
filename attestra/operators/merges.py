"""Changes to keyed tables as folds over logs: the last write of a key, or of a group of its columns, holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write(log: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The row with the greatest ``seq`` of each key; the aggregate combines before the shuffle."""
    others = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*others), seq).alias("_last")).select(*key, "_last.*")


def upserted(table: DataFrame, delta: DataFrame, key: list[str], seq: str) -> DataFrame:
    """``table`` with the rows of ``delta`` put in place of theirs; rows of ``table`` are older than any of ``delta``."""
    old = table.withColumn(seq, F.lit(None).cast(delta.schema[seq].dataType)) if seq not in table.columns else table
    both = old.unionByName(delta.select(*old.columns)).withColumn("_seq", F.coalesce(F.col(seq), F.lit(-1)))
    return last_write(both, key, "_seq").drop("_seq")


def column_groups(log: DataFrame, key: list[str], seq: str, kind: str, groups: dict[str, list[str]]) -> DataFrame:
    """Each group's columns as the last row of its kind left them; others keep what they had."""
    parts = []
    for name, columns in groups.items():
        parts += [F.max_by(F.col(c), F.when(F.col(kind) == name, F.col(seq))).alias(c) for c in columns]
    return log.groupBy(*key).agg(*parts)


def replaced(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the keys in ``rows`` give way to these; what the old ones held is forgotten."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def marked_pending(table: DataFrame, invalid: Column, path: str, status: str) -> DataFrame:
    """Rows found invalid lose their path and get status 0."""
    kind = table.schema[path].dataType
    return table.withColumns({path: F.when(invalid, F.lit(None).cast(kind)).otherwise(F.col(path)), status: F.when(invalid, 0).otherwise(F.col(status))})


# The states of a job and the events that lead to them.
TRANSITIONS = {
    ("none", "enqueue"): "queued", ("queued", "claim"): "running", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancel_requested",
    ("running", "finish"): "completed", ("running", "fail"): "failed", ("cancel_requested", "finish"): "cancelled", ("cancel_requested", "fail"): "cancelled",
    ("running", "recover"): "queued", ("cancel_requested", "recover"): "cancelled",
}


def job_states(events: DataFrame, job: str, seq: str, event: str) -> DataFrame:
    """The final state of each job: its events in order, those that do not fit the state passed over."""
    state = F.lit("none")
    table = F.create_map(*[F.lit(x) for (s, e), to in TRANSITIONS.items() for x in (f"{s} {e}", to)])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(event).alias("event"))))
    step = lambda acc, x: F.coalesce(F.try_element_at(table, F.concat(acc, F.lit(" "), x["event"])), acc)
    return events.groupBy(job).agg(F.aggregate(ordered, state, step).alias("state"), F.count("*").alias("events"))


def wrapped_neighbours(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``previous`` and ``next`` of each row in its group; the ends meet."""
    window = Window.partitionBy(*group).orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({
        "previous": F.coalesce(F.lag(value).over(window), F.last(value).over(whole)), "next": F.coalesce(F.lead(value).over(window), F.first(value).over(whole)),
    })
