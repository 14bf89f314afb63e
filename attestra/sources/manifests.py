"""Readers of manifests, registry extracts, id lists and nested documents; all by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import item_files, panel_files, parsed_bool, text, unquoted

REQUIRED = ["filename", "product_type", "brand_name"]
MANIFEST = [*REQUIRED, "fixture_id", "fanciful_name", "class_type", "alcohol_content", "net_contents", "bottler_producer_name_address", "country_of_origin", "imported", "panel_filenames"]

# Headers of registry extracts and the columns they name.
REGISTRY_HEADERS = {
    "ttb id": "ttb_id", "permit no.": "permit_no", "serial number": "serial_number", "completed date": "completed_date", "fanciful name": "fanciful_name",
    "brand name": "brand_name", "origin": "origin", "origin desc": "origin_desc", "class/type": "class_type", "class/type desc": "class_type_desc",
}


def _plain(name: str) -> str:
    return name.replace("﻿", "").strip()


def items(rows: DataFrame, row: str) -> DataFrame:
    """Manifest items from rows of text columns, and ``error`` (null for good rows); ``row`` names the row's number."""
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    got = {c: F.trim(text(F.col(c).cast("string"))) if c in rows.columns else F.lit("") for c in MANIFEST if c != "panel_filenames"}
    raw_panels = F.col("panel_filenames") if "panel_filenames" in rows.columns else F.lit("")
    listed = dict(rows.dtypes).get("panel_filenames", "").startswith("array")
    panels = F.filter(F.transform(raw_panels, lambda x: F.trim(x)), lambda x: x != "") if listed else panel_files(raw_panels)
    flag = parsed_bool(got["imported"])
    blank = F.array_join(F.filter(F.array(*[F.when(got[c] == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull()), ", ")
    error = F.when(blank != "", F.concat(F.lit("Row "), F.col(row).cast("string"), F.lit(": missing "), blank)).when(flag.isNull(), F.concat(F.lit("Row "), F.col(row).cast("string"), F.lit(": imported is neither true nor false")))
    nulls = {c: F.nullif(got[c], F.lit("")) for c in ("fixture_id", "country_of_origin")}
    return rows.select(F.col(row).alias("row"), *[(nulls.get(c, got[c])).alias(c) for c in MANIFEST if c not in ("imported", "panel_filenames")], flag.alias("imported"), item_files(panels, got["filename"]).alias("files"), error.alias("error"))


def read_csv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with a header; row 2 is the first item, as in the file."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.withColumnsRenamed({c: _plain(c) for c in raw.columns})
    return items(_numbered(raw, 2), "_row")


def read_json_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or an object whose ``items`` are one; row 1 is the first item."""
    raw = spark.read.json(path, multiLine=True)
    if "items" in raw.columns:
        raw = raw.select(F.inline("items"))
    return items(_numbered(raw, 1), "_row")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    low = path.lower()
    if low.endswith(".csv"):
        return read_csv_manifest(spark, path)
    if low.endswith(".json"):
        return read_json_manifest(spark, path)
    raise ValueError("a manifest is a .csv or .json file")


def _numbered(df: DataFrame, first: int) -> DataFrame:
    """Row numbers in the order of the file; a manifest is one file of a few hundred rows."""
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_row", F.row_number().over(Window.orderBy("_at")) + (first - 1)).drop("_at")


def duplicates(manifest: DataFrame) -> DataFrame:
    """Values that occur more than once among application files, panel files and fixture ids."""
    kinds = [("filename", manifest.select(F.col("filename").alias("value"))), ("panel", manifest.select(F.explode("files").alias("value"))), ("fixture_id", manifest.where(F.col("fixture_id").isNotNull()).select(F.col("fixture_id").alias("value")))]
    all_values = None
    for kind, values in kinds:
        values = values.select(F.lit(kind).alias("kind"), "value")
        all_values = values if all_values is None else all_values.unionByName(values)
    return all_values.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry extract: known headers renamed, numbers unquoted, rows without an id left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c: REGISTRY_HEADERS.get(_plain(c).lower(), _plain(c).lower().replace(" ", "_")) for c in raw.columns}
    return raw.select(*[unquoted(F.col(f"`{c}`")).alias(n) for c, n in names.items()]).where(F.col("ttb_id") != "")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids from a text file of one a line, or a CSV with a ``ttb_id`` column."""
    if path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True).select(F.col("ttb_id").alias("id"))
    else:
        rows = spark.read.text(path).select(F.col("value").alias("id"))
    return rows.select(unquoted(F.col("id")).alias("id")).where(F.col("id") != "").distinct()


OCR = "fixture_id string, filename string, full_text string, avg_confidence double, blocks array<struct<text:string,confidence:double,bbox:array<array<double>>>>, source string, preprocessing_ms int, ocr_ms int, total_ms int"


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """Recognised texts, a JSON document a file."""
    return spark.read.schema(OCR).json(path, multiLine=True)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of a folder with the stem of their file name, ``stem``."""
    named = spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("_file"))
    return named.withColumn("stem", F.regexp_replace("_file", r"\.json$", "")).drop("_file")


def combined_panels(panels: DataFrame, item: str, order: str) -> DataFrame:
    """One text per item: panels under headers in order, mean confidence, summed times, sources joined."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("filename"), F.col("full_text"))))
    header = F.transform(ordered, lambda p, i: F.concat(F.lit("[Panel "), (i + 1).cast("string"), F.lit(": "), p["filename"], F.lit("]\n"), p["full_text"]))
    return panels.groupBy(item).agg(
        F.array_join(header, "\n\n").alias("full_text"), F.avg("avg_confidence").alias("avg_confidence"), F.sum("total_ms").alias("total_ms"),
        F.array_join(F.array_sort(F.collect_set("source")), " + ").alias("source"), F.count("*").alias("panels"),
    )


def first_run(rows: DataFrame, keys: list[str], run: str) -> DataFrame:
    """Of the good rows of several runs, the newest run's for each key."""
    return rows.where(F.col("status") == "ok").groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), run).alias("_r")).select(*keys, "_r.*")
