"""Folders of JSON documents with the file they came from: fixtures with sidecars, jobs with results, a corpus of sources and criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text
from .manifests import OCR

# Schemas of the documents, verdicts a criterion may have, the mark of a fixture's text.
APPLICATION = "fixture_id string, filename string, product_type string, brand_name string, fanciful_name string, class_type string, alcohol_content string, net_contents string, country_of_origin string, imported boolean, formula_id string, statement_of_composition string"
EXPECTED = "fixture_id string, filename string, overall_verdict string, top_reason string, checked_rule_ids array<string>, triggered_rule_ids array<string>"
MANIFEST = "job_id string, items array<struct<item_id:string,fixture_id:string,filename:string>>"
RESULT = "job_id string, item_id string, filename string, overall_verdict string, top_reason string, total_ms double, policy_queue string"
SOURCES = "sources array<struct<source_id:string>>"
CRITERIA = "criteria array<struct<rule_id:string,source_refs:array<string>,confidence_tier:string,default_verdict:string,fixtures:array<string>>>"
PROVENANCE = "fixtures array<struct<fixture_id:string,rule_ids:array<string>,source_refs:array<string>>>"
VERDICTS = ["pass", "fail", "needs_review", "info"]
GROUND_TRUTH = "fixture ground truth"


def _named(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of a path with ``_path``, ``_name`` and when the file was ``changed``."""
    meta = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_modification_time").alias("changed")]
    return spark.read.schema(schema).json(path, multiLine=True).select("*", *meta)


def _folder(path: Column, above: int) -> Column:
    """The folder's name so many levels above a file."""
    return F.url_decode(F.element_at(F.split(path, "/"), -1 - above))


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Every fixture of a folder: ``fixture_id``, ``application``, ``ocr`` and ``expected`` of its sidecars, null where one is missing.

    The id is what the file is named before its suffix, whatever the document says of itself.
    """
    whole = None
    for suffix, column, schema in (("application", "application", APPLICATION), ("ocr_text", "ocr", OCR), ("expected", "expected", EXPECTED)):
        rows = _named(spark, f"{folder.rstrip('/')}/*.{suffix}.json", schema)
        of = F.struct(*[F.lit(GROUND_TRUTH).alias(c) if (column, c) == ("ocr", "source") else F.col(c) for c in rows.columns if c not in ("_path", "_name", "changed")])
        side = rows.select(F.regexp_replace("_name", rf"\.{suffix}\.json$", "").alias("fixture_id"), of.alias(column))
        whole = side if whole is None else whole.join(side, "fixture_id", "full")
    return whole


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """A row for each job below ``root``: its items, when its manifest last changed, and its results in the order of their files."""
    manifests = _named(spark, f"{root.rstrip('/')}/*/manifest.json", MANIFEST).select(_folder(F.col("_path"), 1).alias("job_id"), "items", "changed")
    results = read_results(spark, root).groupBy(F.col("job_id").alias("_job")).agg(F.array_sort(F.collect_list(F.struct("file", "result"))).alias("_r"))
    rows = manifests.join(results, F.col("job_id") == F.col("_job"), "left")
    kind = f"array<struct<{','.join(c.replace(' ', ':') for c in RESULT.split(', '))}>>"
    return rows.select("job_id", "items", "changed", F.coalesce(F.transform("_r", lambda r: r["result"]), F.array().cast(kind)).alias("results"))


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """Every result of every job: the job's folder, the file's name and the ``result``."""
    rows = _named(spark, f"{root.rstrip('/')}/*/results/*.json", RESULT)
    return rows.select(_folder(F.col("_path"), 2).alias("job_id"), F.col("_name").alias("file"), F.struct("job_id", "item_id", "filename", "overall_verdict", "top_reason", "total_ms", "policy_queue").alias("result"))


def read_corpus(spark: SparkSession, ledger: str, criteria: str, provenance: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, criteria and fixtures, a row each, from one document each."""
    return tuple(spark.read.schema(schema).json(path, multiLine=True).select(F.inline(column)) for path, schema, column in ((ledger, SOURCES, "sources"), (criteria, CRITERIA, "criteria"), (provenance, PROVENANCE, "fixtures")))


def corpus_errors(sources: DataFrame, criteria: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``item`` and ``error`` of everything that is wrong: references to sources or rules that are not there, and verdicts a criterion must not have.

    A null list has no references; null tiers and verdicts count as empty.
    """
    tier, verdict = text(F.col("confidence_tier")), text(F.col("default_verdict"))
    wrong = F.array_compact(F.array(
        F.when((tier.startswith("tier_2") | tier.startswith("tier_3")) & (verdict == "fail"), "Tier 2/3 rule must not default to Fail"),
        F.when(~verdict.isin(VERDICTS), F.concat(F.lit("invalid default_verdict "), verdict)),
        F.when((verdict != "info") & (F.coalesce(F.size("fixtures"), F.lit(0)) <= 0), "non-info rule has no fixtures"),
    ))
    own = criteria.select(F.col("rule_id").alias("item"), F.explode(wrong).alias("error"))

    def absent(rows: DataFrame, item: str, refs: str, known: DataFrame, key: str, says: str) -> DataFrame:
        each = rows.select(F.col(item).alias("item"), F.explode(refs).alias("ref"))
        return each.join(known.select(F.col(key).alias("_known")).distinct(), F.col("ref") == F.col("_known"), "left_anti").select("item", F.concat(F.lit(says), "ref").alias("error"))

    return (
        absent(criteria, "rule_id", "source_refs", sources, "source_id", "missing source_ref ").unionByName(own)
        .unionByName(absent(fixtures, "fixture_id", "rule_ids", criteria, "rule_id", "references missing rule_id "))
        .unionByName(absent(fixtures, "fixture_id", "source_refs", sources, "source_id", "references missing source_ref "))
    )
