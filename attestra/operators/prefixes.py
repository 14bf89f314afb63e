"""Numbers along an order, and scans that stop once enough is found, without one task that sorts a whole table or group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .records import first_reason

#: Rows that bounds of ranges are taken from, and ranges. Bounds only deal work out; no result depends on them.
SAMPLE, RANGES = 2048, 64


def _bounds(df: DataFrame, order: list[str], ranges: int) -> list:
    """Values that part ``df`` into about ``ranges`` equal ranges of ``order``: of the rows whose values hash least."""
    some = df.select(F.struct(*order).alias("at")).orderBy(F.xxhash64("at"), "at").limit(SAMPLE).select("at").orderBy("at").collect()  # SAMPLE rows
    step = max(1, len(some) // ranges)
    return [r["at"] for r in some[step::step]]


def _range_of(df: DataFrame, order: list[str], ranges: int) -> Column:
    """The number of bounds that are not behind a row: 0 for the first range."""
    bounds, out = _bounds(df, order, ranges), F.lit(0)
    kinds = {f.name: f.dataType for f in df.select(*order).schema.fields}
    for i, b in enumerate(bounds):
        out = F.when(F.struct(*order) >= F.struct(*[F.lit(b[c]).cast(kinds[c]).alias(c) for c in order]), i + 1).otherwise(out)
    return out


def kept_until_enough(df: DataFrame, order: list[str], limit: int, ranges: int = RANGES, **reasons: Column) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows that no reason is against, and how many rows each first reason took before the last of these.

    As a loop over the rows in ``order`` (which names a row) that stops when it has
    enough: rows behind the stop are neither kept nor counted. A first pass counts
    what each range of the order keeps; only the range in which the limit falls is
    sorted, to find the stop; a second pass reads up to it, which a filter on the
    order's columns does. ``kept`` counts as a reason of its own.
    """
    reason, at = first_reason(**reasons), F.struct(*order)
    marked = df.withColumns({"_reason": reason})
    counts = marked.where("_reason = 'kept'").groupBy(_range_of(df, order, ranges).alias("r")).count().collect()  # one row for each range
    stop, left = None, limit
    for r in sorted(counts):
        if r["count"] >= left > 0:
            inside = marked.withColumn("_r", _range_of(df, order, ranges)).where((F.col("_r") == r["r"]) & (F.col("_reason") == "kept"))
            stop = inside.select(*order).orderBy(*order).limit(left).agg(F.max(at).alias("stop")).first()["stop"]
            left = 0
            break
        left -= r["count"]
    if limit <= 0:
        marked = marked.where(F.lit(False))
    elif stop is not None:
        kinds = {f.name: f.dataType for f in df.select(*order).schema.fields}
        last = F.struct(*[F.lit(stop[c]).cast(kinds[c]).alias(c) for c in order])
        first = F.col(order[0]) <= F.lit(stop[order[0]]).cast(kinds[order[0]])
        # The first column's bound reaches the scan; with nulls first in the order it must not drop them.
        marked = marked.where((F.col(order[0]).isNull() | first) & (at <= last))
    return marked.where("_reason = 'kept'").drop("_reason"), marked.groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def many_ranges(df: DataFrame) -> int:
    """Four ranges for each shuffle partition: they get no longer as a table grows with the partitions it is given."""
    return max(RANGES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_range(mark: Column, ranges: int) -> Column:
    """The range of a hash in hex digits, of so many equal ones."""
    return F.floor(F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") * ranges / 2**32).cast("int")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, place: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``name``: a row's number from 1 in its group along ``order``, which should name a row.

    Rows are numbered within ranges of the order (``place`` says which, if the order
    has ranges of its own) and the ranges' sizes added up, so a group of any size is
    sorted by as many tasks as it has ranges.
    """
    ranged = df.withColumn("_range", _range_of(df, order, ranges) if place is None else place)
    nth = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)).cast("bigint")
    sizes = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("_size"))
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("_range") == F.col("_r"))
    met = ranged.withColumn("_nth", nth).join(starts, on).withColumns({name: F.col("_nth") + F.col("_before"), f"{name}_of": F.col("_size")})
    return met.drop("_range", "_nth", "_r", "_before", "_size", *[f"_{g}" for g in group])


def counting_skipped(df: DataFrame, name: str, **reasons: Column) -> tuple[DataFrame, Observation]:
    """Rows that no reason is against; an :class:`Observation` has how many each first reason took, once the result is written.

    Both come from the same pass: nothing is scanned for the counts.
    """
    seen = Observation(name)
    marked = df.withColumn("_reason", first_reason(**reasons))
    counts = [F.count_if(F.col("_reason") == r).alias(r) for r in [*reasons, "kept"]]
    return marked.observe(seen, *counts).where("_reason = 'kept'").drop("_reason"), seen
