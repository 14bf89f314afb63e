"""Graphs of recognised blocks for one field: twenty numbers for each node, and a sparse adjacency whose rows sum to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.evidence import overlap
from ..functions.records import number_hit, unit_match
from ..functions.text import label_text
from .records import top_nodes

# The fields in the order of their one-hot places, the distance of another panel.
FIELDS = ["brand_name", "fanciful_name", "class_type", "alcohol_content", "net_contents", "country_of_origin"]
PANEL_APART = 2.0


def geometry(box: Column) -> Column:
    """Centre, size, area and aspect of a box of two points, all from 0 to 1; without such a box the middle, and no size."""
    within = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x0, y0, x1, y1 = (F.try_element_at(F.try_element_at(box, F.lit(p)), F.lit(c)).cast("double") for p, c in ((1, 1), (1, 2), (2, 1), (2, 2)))
    w, h = within(x1 - x0), within(y1 - y0)
    aspect = F.least(F.when(h > 0, w / h).otherwise(0.0), F.lit(20.0)) / 20.0
    given = (F.size(box) == 2) & (F.size(box[0]) == 2) & (F.size(box[1]) == 2) & x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    names = ["x", "y", "width", "height", "area", "aspect"]
    shape = F.struct(*[v.alias(k) for k, v in zip(names, [within(x0 + w / 2), within(y0 + h / 2), w, h, w * h, aspect], strict=True)])
    middle = F.struct(*[F.lit(v).alias(k) for k, v in zip(names, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], strict=True)])
    return F.when(F.coalesce(given, F.lit(False)), shape).otherwise(middle)


def node_features(field: Column, expected: Column, seen: Column, similarity: Column, confidence: Column, shape: Column, panel: Column, panels: Column) -> Column:
    """Confidence, :func:`geometry`, length, similarity, shared words, number, unit, place and number of panels, and the field one-hot."""
    length = F.least(F.length(label_text(seen)), F.lit(40)) / 40.0
    numbers = [confidence, *[shape[k] for k in ("x", "y", "width", "height", "area", "aspect")], length, similarity, overlap(expected, seen), number_hit(expected, seen), unit_match(expected, seen),
               panel / F.greatest(panels, F.lit(1)), panels / 10.0, *[F.when(field == f, 1.0).otherwise(0.0) for f in FIELDS]]
    return F.array(*[c.cast("double") for c in numbers])


def adjacency(nodes: DataFrame, key: str, place: str, k: int) -> DataFrame:
    """``key``, ``a``, ``b``, ``weight``: each node with itself and its ``k`` nearest of the graph, both ways, weights of a row summing to one.

    ``nodes`` have ``shape`` and ``panel``; equal distances go by place. Graphs are
    at most as large as :func:`feature_graphs` keeps them, so pairs within one are few.
    """
    one = nodes.select(F.col(key).alias("g"), F.col(place).alias("a"), F.col("shape.x").alias("x"), F.col("shape.y").alias("y"), F.col("panel").alias("p"))
    two = one.select(F.col("g").alias("h"), F.col("a").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("p").alias("q"))
    gap = F.sqrt(F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("v"), 2)) + F.when(F.col("p") != F.col("q"), PANEL_APART).otherwise(0.0)
    pairs = one.join(two, (F.col("g") == F.col("h")) & (F.col("a") != F.col("b"))).groupBy("g", "a").agg(F.slice(F.array_sort(F.collect_list(F.struct(gap.alias("gap"), "b"))), 1, k).alias("near"))
    near = pairs.select("g", "a", F.explode("near.b").alias("b"))
    edges = near.unionByName(near.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(one.select("g", "a", F.col("a").alias("b"))).distinct()
    return edges.select(F.col("g").alias(key), "a", "b", (1.0 / F.count("*").over(Window.partitionBy("g", "a"))).alias("weight"))


def feature_graphs(nodes: DataFrame, key: str, order: str, rank: Column, most: int, k: int) -> DataFrame:
    """For each graph ``x`` (its nodes' ``features`` in their order), ``adj`` (a, b, weight) and ``node_count``; the ``most`` nodes of highest ``rank`` are kept."""
    kept = top_nodes(nodes, key, rank, order, most).withColumn("at", F.col("place") - 1)
    edges = adjacency(kept, key, "at", k).groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "weight"))).alias("adj"))
    x = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "features"))), lambda v: v["features"]).alias("x"), F.count("*").alias("node_count"))
    return x.join(edges, F.col(key) == F.col("_key")).drop("_key")
