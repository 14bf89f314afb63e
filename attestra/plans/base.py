"""Inputs that the queries derive from the driver's tables, in Spark and as SQL.

No table holds label text, so applications and labels are put together from
``lineitem`` and ``part``; the SQL is the same in both dialects and covers every
verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.evidence import WARNING

LABELS_SQL = f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  (l.l_orderkey * 10000000 + l.l_partkey) * 10 + l.l_linenumber AS item_id,
  'job' || CAST(l.l_orderkey % 50 AS STRING) AS job_id,
  'label_' || CAST(l.l_orderkey AS STRING) || '_' || CAST(l.l_linenumber AS STRING) || '.png' AS filename,
  CASE l.l_partkey % 3 WHEN 0 THEN 'malt_beverage' WHEN 1 THEN 'wine' ELSE 'distilled_spirits' END AS product_type,
  p.p_brand AS brand_name,
  CASE WHEN l.l_partkey % 4 = 0 THEN '' ELSE p.p_name END AS fanciful_name,
  p.p_type AS class_type,
  CASE WHEN l.l_partkey % 11 = 0 THEN '' WHEN l.l_partkey % 23 = 0 THEN 'strong'
    ELSE CAST(p.p_size + CASE WHEN l.l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS STRING) || '% ALC/VOL' END AS alcohol_content,
  CASE WHEN l.l_partkey % 29 = 0 THEN '' ELSE CAST(p.p_size * 25 AS STRING) || ' mL' END AS net_contents,
  CASE WHEN l.l_suppkey % 6 = 0 THEN '' ELSE 'Supplier ' || CAST(l.l_suppkey AS STRING) END AS bottler_producer_name_address,
  CASE WHEN l.l_suppkey % 9 = 0 THEN '' WHEN l.l_suppkey % 2 = 0 THEN 'France' ELSE 'United States' END AS country_of_origin,
  l.l_suppkey % 4 <> 3 AS imported,
  CAST(CASE WHEN l.l_orderkey % 19 = 0 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS avg_confidence,
  CAST(20 + l.l_partkey % 300 AS INT) AS total_ms,
  p.p_name || ' ' || CASE WHEN l.l_linenumber % 7 = 6 THEN 'OTHER MARK' ELSE p.p_brand END || ' ' || p.p_type
    || CASE WHEN l.l_partkey % 7 = 0 THEN '' ELSE ' ' || CAST(p.p_size AS STRING) || '% ALC/VOL' END
    || CASE WHEN l.l_partkey % 13 = 0 THEN ' 5.5% ABV' WHEN l.l_partkey % 31 = 0 THEN ' 90 proof' ELSE '' END
    || CASE WHEN l.l_partkey % 5 = 0 THEN '' WHEN l.l_partkey % 17 = 0 THEN ' 16 FL. OZ.'
       ELSE ' ' || CAST(p.p_size * 25 + CASE WHEN l.l_linenumber % 4 = 0 THEN 100 ELSE 0 END AS STRING) || ' mL' END
    || ' BOTTLED BY SUPPLIER ' || CAST(l.l_suppkey + CASE WHEN l.l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS STRING)
    || CASE l.l_suppkey % 5 WHEN 0 THEN ' PRODUCT OF FRANCE' WHEN 1 THEN ' PRODUCT OF ITALY' WHEN 2 THEN ' PRODUCT OF U.S.A.' ELSE '' END
    || CASE WHEN l.l_partkey % 10 = 3 THEN '' WHEN l.l_partkey % 10 = 6 THEN ' Government Warning: (1) drink less'
       WHEN l.l_partkey % 10 = 9 THEN ' {WARNING[:-1]}' ELSE '  {WARNING.replace(": (1)", ":  (1)")} ' END AS full_text
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""


def folded_sql(c: str) -> str:
    """Accented and wide letters as ASCII, each mark as a space."""
    return f"translate(regexp_replace({c}, '([{tx.MARKED}])', '\\1 ', 'g'), '{tx.FOLDED}', '{tx.FOLDED_TO}')"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small table over as many tasks as there are cores, for what is dear per row; a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with the text of their labels."""
    return labelled(spread(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"), load(spark, sf_dir, "part"))


def labelled(items: DataFrame, part: DataFrame) -> DataFrame:
    """The same of some of the items."""
    spark = items.sparkSession
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A method of generated code above this size is only ever interpreted by the JVM; Spark then takes projections apart instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    return spark.sql(LABELS_SQL.replace("FROM lineitem l JOIN part p", "FROM {lineitem} l JOIN {part} p"), lineitem=items, part=part)


def lone_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`labels` that are their item's only one, and all others.

    Four keys of each item are shuffled for this, never its text, by the part that its id
    names; that is its part but for an id that several parts could make, so the first rows
    join ``part`` where they are. If a part is listed twice, all items are others.
    """
    items, part = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"), load(spark, sf_dir, "part")
    number = "(l_orderkey * 10000000 + l_partkey) * 10 + l_linenumber"
    # Never null, or a filter that only one of the two results has would keep them from sharing the shuffle.
    item, named = F.expr(number), F.expr(f"coalesce(pmod(({number}) div 10, 10000000L), -1L)")
    if not part.groupBy("p_partkey").count().where("count > 1").isEmpty():
        return labelled(items.limit(0), part), labelled(items, part)
    counted = items.repartition(named).withColumns({"_named": named, "_item": item}).withColumn("_rows", F.count("*").over(Window.partitionBy("_named", "_item")))
    lone = F.coalesce((F.col("_rows") == 1) & (F.col("l_partkey") == F.col("_named")), F.lit(False))
    return labelled(counted.where(lone).withColumn("l_partkey", F.col("_named")), part), labelled(counted.where(~lone), part)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label (``quality``) and a score between 0 and 1 from their length."""
    docs, marks = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return docs.join(marks, "doc_id").select("doc_id", "lang", "source", "quality", "toxic", (F.least(F.col("n_chars"), F.lit(5000)) / 5000.0).alias("score"))


SCORED_SQL = "SELECT d.doc_id, d.lang, d.source, m.quality, m.toxic, least(d.n_chars, 5000) / 5000.0 AS score FROM documents d JOIN labels m ON d.doc_id = m.doc_id"


def engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three engines for a field of each vector, from its first coordinates."""
    v = load(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.element_at(F.array(*map(F.lit, ["brand_name", "alcohol_content", "class_type"])), (F.col("vec_id") % 3 + 1).cast("int")).alias("field"), (F.col("label") >= 5).cast("int").alias("truth"),
                    F.create_map(*[x for i, e in enumerate(ENGINES) for x in (F.lit(e), F.round(50 + 200 * F.col("embedding")[i].cast("double"), 6))]).alias("scores"))


ENGINES = ["doctr", "paddleocr", "openocr"]
ENGINES_SQL = """SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'brand_name' WHEN 1 THEN 'alcohol_content' ELSE 'class_type' END AS field, CAST(label >= 5 AS INT) AS truth,
  round(50 + 200 * CAST(embedding[1] AS DOUBLE), 6) AS s1, round(50 + 200 * CAST(embedding[2] AS DOUBLE), 6) AS s2, round(50 + 200 * CAST(embedding[3] AS DOUBLE), 6) AS s3 FROM embeddings"""
