"""Deterministic samples, allocations, splits and pairs.

Every shuffle is an order by a salted sha256 of the row's key, so results do
not depend on partitions. Membership therefore differs from samplers that use a
seeded generator; sizes, floors and disjointness are the same. Allocations run
over strata (few rows); rows are numbered within ranges of a hash or an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import order_hash
from .prefixes import hash_range, many_ranges, numbered


def _all() -> Window:
    """One window over all rows; only strata and ranges pass through it, never the table."""
    return Window.partitionBy()


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def allocated(strata: DataFrame, key: str, size: str, target: int, floor: int = 0) -> DataFrame:
    """``target`` shared out by largest remainders: ``quota`` of each stratum.

    Each stratum first gets ``floor``, or all it has; floors may add up to more
    than the target and then stand. The rest is shared in proportion to what is
    left of each. Leftovers go by remainder, room, then key, all descending, one
    each, to strata with room.
    """
    base = strata.withColumn("_base", F.least(F.col(size), F.lit(floor).cast("bigint")))
    base = base.withColumns({"_room": F.col(size) - F.col("_base"), "_rest": F.greatest(F.lit(0), F.lit(target) - F.sum("_base").over(_all()))})
    share = F.when(F.col("_room") == 0, 0.0).otherwise(F.col("_rest") * (F.col("_room") / F.sum("_room").over(_all())))
    base = base.withColumn("_share", share).withColumn("_extra", F.least(F.col("_room"), F.floor("_share").cast("bigint")))
    left = F.col("_rest") - F.sum("_extra").over(_all())
    base = base.withColumns({"_left": left, "_open": F.col("_extra") < F.col("_room"), "_part": F.col("_share") - F.col("_extra")})
    nth = F.row_number().over(_all().orderBy(F.desc("_open"), F.desc("_part"), F.desc("_room"), F.desc(key)))
    return base.select(*strata.columns, (F.col("_base") + F.col("_extra") + F.when(F.col("_open") & (nth <= F.col("_left")), 1).otherwise(0)).cast("bigint").alias("quota"))


def allocated_exactly(strata: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """``quota`` of each stratum in proportion to its size, ``target`` in all: floors first, then one each by remainder and key, both descending, to strata with room.

    A target below none or above all rows is an error. Strata named null are ``unknown``.
    """
    named = strata.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key), F.col(size).cast("bigint").alias(size)).groupBy(key).agg(F.sum(size).alias(size))
    total = named.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if not 0 <= target <= total:
        raise ValueError(f"the target must be between 0 and {total}")
    exact = F.lit(target) * (F.col(size) / F.lit(max(total, 1)))
    base = named.withColumn("_exact", exact).withColumn("_base", F.least(F.col(size), F.floor("_exact").cast("bigint")))
    base = base.withColumns({"_open": (F.col("_base") < F.col(size)).cast("int"), "_left": F.lit(target) - F.sum("_base").over(_all())})
    first = F.row_number().over(_all().orderBy(F.desc("_open"), F.desc(F.col("_exact") - F.col("_base")), F.desc(key)))
    base = base.withColumn("_one", F.when((F.col("_open") == 1) & (first <= F.col("_left")), 1).otherwise(0))
    #: What rounding leaves over goes one each in the order of keys to strata that still have room.
    base = base.withColumns({"_more": F.col("_left") - F.sum("_one").over(_all()), "_room": (F.col("_base") + F.col("_one") < F.col(size)).cast("int")})
    second = F.row_number().over(_all().orderBy(F.desc("_room"), key))
    extra = F.when((F.col("_room") == 1) & (second <= F.col("_more")), 1).otherwise(0)
    return base.select(key, size, (F.col("_base") + F.col("_one") + extra).alias("quota"))


def by_quota(df: DataFrame, quotas: DataFrame, key: str, seed: str, ids: list[str]) -> DataFrame:
    """As many rows of each stratum as its quota, in the order of their hash."""
    mark = order_hash(seed, *[F.col(i) for i in ids])
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(mark, *ids)))
    small = quotas.select(F.col(key).alias("_key"), "quota")
    return ranked.join(small, F.col(key) == F.col("_key")).where(F.col("_n") <= F.col("quota")).drop("_n", "_key", "quota")


def round_robin(df: DataFrame, strata: list[str], seed: str, ids: list[str], target: int) -> DataFrame:
    """Rows drawn in turn from each stratum until ``target`` are drawn; ``draw`` is their place."""
    mark = order_hash(seed, *[F.col(i) for i in ids])
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(mark, *ids))
    group = order_hash(seed, *[F.col(s) for s in strata])
    #: No stratum can give more than all that is drawn, so each task keeps so many of it.
    drawn = df.withColumn("_turn", turn).where(F.col("_turn") <= target).withColumn("_group", group).orderBy("_turn", "_group").limit(target)
    return drawn.withColumn("draw", F.row_number().over(_all().orderBy("_turn", "_group"))).drop("_turn", "_group")


def split_by_ratio(df: DataFrame, group: list[str], seed: str, ids: list[str], parts: dict[str, float]) -> DataFrame:
    """``split`` by cumulative shares of each group's rows, floored; the last part takes the rest."""
    marked = df.withColumn("_mark", order_hash(seed, *[F.col(i) for i in ids]))
    drawn = numbered(marked, group, ["_mark", *ids], "_place", hash_range(F.col("_mark"), many_ranges(df)))
    names, shares = list(parts), list(parts.values())
    out, upto = F.lit(names[-1]), []
    for i in range(len(names) - 1):
        upto.append(sum(F.floor(F.col("_place_of") * s).cast("bigint") for s in shares[: i + 1]))
    for name, most in reversed(list(zip(names[:-1], upto, strict=True))):
        out = F.when(F.col("_place") <= most, name).otherwise(out)
    return drawn.withColumn("split", out).drop("_mark", "_place", "_place_of")


def exact_cut(df: DataFrame, seed: str, ids: list[str], size: int, first: str, rest: str) -> DataFrame:
    """``split`` is ``first`` for exactly ``size`` rows, by their hash, else ``rest``."""
    mark = order_hash(seed, *[F.col(i) for i in ids])
    chosen = df.select(*ids, mark.alias("_mark")).orderBy("_mark", *ids).limit(size).select(*[F.col(i).alias(f"_{i}") for i in ids], F.lit(first).alias("_split"))
    on = [F.col(i).eqNullSafe(F.col(f"_{i}")) for i in ids]
    return df.join(chosen, on, "left").withColumn("split", F.coalesce("_split", F.lit(rest))).drop("_split", *[f"_{i}" for i in ids])


def fetch_order(df: DataFrame, seed: str, ids: list[str]) -> DataFrame:
    """Places 1 to n in the order of the hash, without one task for all rows: see :func:`prefixes.numbered`."""
    marked = df.withColumn("_mark", order_hash(seed, *[F.col(i) for i in ids]))
    return numbered(marked, [], ["_mark", *ids], "fetch_order", hash_range(F.col("_mark"), many_ranges(df))).drop("_mark", "fetch_order_of")


def split_families(df: DataFrame, family: str, member: Column, other: Column, seed: str, train: float = 0.70, validation: float = 0.85, least: int = 6) -> DataFrame:
    """``df`` with ``split``: whole families go to train, validation or test, by the order of their hashes.

    Families with a ``member`` row and an ``other`` row count; with fewer than ``least``
    of them all families do, and the others are left out. Up to ``train`` and ``validation`` of
    the families are cut off, one family at least each. Where none is left for test, the last of
    validation is test, and with none left in validation either, the last of train stands in
    both (one, two or three families only).
    """
    each = df.groupBy(F.col(family).alias("_family")).agg(F.max(member.cast("int")).alias("_a"), F.max(other.cast("int")).alias("_b"))
    both = (F.col("_a") == 1) & (F.col("_b") == 1)
    usable, every = each.agg(F.count_if(both), F.count("*")).first()
    n = usable if usable >= least else every
    drawn = fetch_order((each.where(both) if usable >= least else each).select("_family"), seed, ["_family"])
    cut = max(1, int(n * train))
    upto = max(cut + 1, int(n * validation))
    place = F.col("fetch_order")
    splits = F.when(place <= cut, "train").when(place <= upto, "validation").otherwise("test")
    labels = F.array(splits)
    if n <= upto:
        tail = n if n > cut else 0
        stands = n - cut <= 1
        labels = F.when(place == tail, F.array(F.lit("test"))).when((place == min(cut, n)) & F.lit(stands), F.array(F.lit("train"), F.lit("validation"))).otherwise(labels)
    of = drawn.select(F.col("_family"), F.explode(labels).alias("split"))
    return df.join(of, F.col(family).eqNullSafe(F.col("_family"))).drop("_family")


def business_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each weekday from Monday to Friday between two date columns."""
    days = df.withColumn("day", F.explode(F.sequence(F.col(start), F.col(end))))
    return days.where(F.weekday("day") < 5)


def sampled_days(days: DataFrame, seed: str, per_month: int, primary: int = 2) -> DataFrame:
    """``per_month`` days of each month by hash; in order of date the first ``primary`` are primary, the others backup."""
    month = F.date_format("day", "yyyy-MM")
    ranked = days.withColumn("month", month).withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(order_hash(seed, F.col("day")), "day")))
    dated = ranked.where(F.col("rank") <= per_month).withColumn("ord", F.row_number().over(Window.partitionBy("month").orderBy("day")))
    return dated.select("month", "day", F.when(F.col("ord") <= primary, "primary").otherwise("backup").alias("role"), "ord")


def until_enough(days: DataFrame, group: str, order: str, usable: str, least: int) -> DataFrame:
    """Days of a group until those before already have ``least`` usable rows."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("_before", F.coalesce(F.sum(usable).over(before), F.lit(0))).where(F.col("_before") < least).drop("_before")


def chunked(df: DataFrame, split: str, order: list[str], size: int, name: str) -> DataFrame:
    """Jobs of ``size`` rows that start anew in each split."""
    rows = numbered(df, [split], order, "_place").withColumn("chunk", (F.floor((F.col("_place") - 1) / size) + 1).cast("int")).drop("_place", "_place_of")
    return rows.withColumn("job", F.format_string("%s_%s_%06d", F.col(split), F.lit(name), F.col("chunk")))


def negative_pairs(targets: DataFrame, group: list[str], id_col: str, value: str, seed: str, per_target: int) -> DataFrame:
    """For each target ``per_target`` others of its group with another id and another value.

    Others are the next in the group's hash order, cyclically, however far they
    are: rows of one id lie side by side and are passed at once, and so is a run
    of the target's own value, so each negative is one join by place.
    """
    known = targets.select(*group, id_col, value).where(F.col(id_col).isNotNull() & F.col(value).isNotNull())
    order = [order_hash(seed, F.col(id_col)), F.col(id_col), F.col(value)]
    own = Window.partitionBy(*group, id_col)
    ring = known.withColumns({"_at": F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1, "_n": F.count("*").over(Window.partitionBy(*group))})
    ring = ring.withColumns({"_cur": F.max("_at").over(own) + 1, "_stop": F.min("_at").over(own) + F.col("_n")})
    #: Two turns of the ring, each place with the first after it that has another value.
    turns = ring.withColumn("_place", F.explode(F.array(F.col("_at").cast("long"), F.col("_at") + F.col("_n"))))
    turns = turns.withColumn("_new", F.col(value) != F.lag(value).over(Window.partitionBy(*group).orderBy("_place")))
    here = F.struct(F.col("_place").alias("at"), F.col(id_col).alias("id"), F.col(value).alias("value"))
    back = Window.partitionBy(*group).orderBy(F.col("_place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select(*[F.col(g).alias(f"_{g}") for g in group], "_place", here.alias("_here"), F.min(F.when(F.col("_new"), here)).over(back).alias("_next"))
    found, cur = None, ring
    for nth in range(1, per_target + 1):
        met = cur.join(turns, [F.col(g) == F.col(f"_{g}") for g in group] + [F.col("_cur") == F.col("_place")])
        met = met.withColumn("_other", F.when(F.col("_here.value") != F.col(value), F.col("_here")).otherwise(F.col("_next"))).where(F.col("_other.at") < F.col("_stop"))
        one = met.select(*group, id_col, value, F.col("_other.id").alias(f"candidate_{id_col}"), F.col("_other.value").alias(f"candidate_{value}"), F.lit(nth).alias("negative"))
        found = one if found is None else found.unionByName(one)
        cur = met.select(*group, id_col, value, "_stop", (F.col("_other.at") + 1).alias("_cur"))
    return found
