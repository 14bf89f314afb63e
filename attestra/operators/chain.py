"""The evaluation of whole applications: parsed records and registry give what is expected, recognised panels what is seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import tokens, word_score
from ..functions.records import expected_producer
from ..functions.text import falsy_collapsed, text, unquoted
from ..functions.variants import field_variants
from .records import downloaded

# The fields in order, thresholds, and what a reviewer is told.
FIELDS = ["brand_name", "fanciful_name", "class_type", "alcohol_content", "net_contents", "country_of_origin", "applicant_or_producer"]
PASS, REVIEW = 90.0, 75.0
NO_VALUE = "No application value was available for this field."
NO_ACTION = "No reviewer action needed for this field."
AMBIGUOUS = "Review this field manually; OCR found a partial or ambiguous match."
NOT_FOUND = "Review this field manually; OCR did not find strong label evidence."
EVIDENCE = 500


def expected(parsed: DataFrame, registry: DataFrame) -> DataFrame:
    """``ttb_id``, ``status``, ``source_of_product`` and a column for each of ``FIELDS``.

    ``parsed`` has ``application`` and ``form_fields``: the first value that is not blank counts. The
    country is the registry's, and only of an imported product. Of several registry rows of an id the least counts.
    """
    known = registry.groupBy(unquoted(F.col("ttb_id")).alias("_id")).agg(F.min("origin_desc").alias("_origin"))
    rows = parsed.withColumn("ttb_id", unquoted(F.col("ttb_id"))).join(known, F.col("ttb_id") == F.col("_id"), "left")
    form, application = F.col("form_fields"), F.col("application")
    source = text(form["source_of_product"])
    imported = F.coalesce(application["imported"], F.lit(False)) | (F.lower(source) == "imported")
    pick = lambda a, b: falsy_collapsed(F.coalesce(F.nullif(a, F.lit("")), b))
    values = {c: pick(application[c], form["class_type_description" if c == "class_type" else c]) for c in FIELDS[:5]}
    values |= {"country_of_origin": F.when(imported, falsy_collapsed(F.col("_origin"))).otherwise(""), "applicant_or_producer": expected_producer(form["applicant_name_address"])}
    return rows.select("ttb_id", text(form["status"]).alias("status"), source.alias("source_of_product"), *[v.alias(c) for c, v in values.items()])


def read_panels(attachments: DataFrame, ocr: DataFrame) -> DataFrame:
    """Downloaded panels with ``full_text``, ``total_ms`` and ``cache_hit`` of their recognition, null where there is none."""
    panels = downloaded(attachments, "raw_image_path", "http_status").withColumn("ttb_id", unquoted(F.col("ttb_id")))
    read = ocr.select(unquoted(F.col("ttb_id")).alias("_id"), F.col("panel_order").alias("_order"), text(F.col("full_text")).alias("full_text"), F.coalesce("total_ms", F.lit(0)).alias("total_ms"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"))
    return panels.join(read, (F.col("ttb_id") == F.col("_id")) & (F.col("panel_order") == F.col("_order")), "left").drop("_id", "_order")


def field_results(wanted: DataFrame, panels: DataFrame, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A row for each application with a recognised panel and each of ``FIELDS``, blank ones too.

    The first panel and variant with the best score count, none where all score zero. A panel's words are
    taken apart once, before they meet the fields; the best is a partial aggregate.
    """
    seen = panels.where(F.col("full_text").isNotNull()).select(F.col("ttb_id").alias("_id"), "panel_order", "image_type", "filename", "full_text", (F.lit(None) if score else tokens(F.col("full_text"))).alias("_words"))
    rows = wanted.join(seen.select("_id").distinct(), F.col("ttb_id") == F.col("_id"), "left_semi")
    long = rows.select("ttb_id", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("field_name"), F.col(c).alias("expected")) for i, c in enumerate(FIELDS)])).alias("f")).select("ttb_id", "f.*")
    tried = long.select("*", F.posexplode_outer(field_variants(F.col("field_name"), F.col("expected"))).alias("variant", "candidate"))
    met = tried.where(F.col("candidate").isNotNull()).join(seen, F.col("ttb_id") == F.col("_id"))
    points = score(F.col("candidate"), F.col("full_text")) if score else word_score(tokens(F.col("candidate")), F.col("_words"))
    order = F.struct(-F.col("_points"), F.col("panel_order"), F.col("variant"))
    best = met.withColumn("_points", points).groupBy("ttb_id", "field_name").agg(F.min_by(F.struct("_points", "panel_order", "image_type", "filename", F.substring("full_text", 1, EVIDENCE).alias("evidence")), order).alias("b"))
    best = best.select(F.col("ttb_id").alias("_id"), F.col("field_name").alias("_field"), "b")
    out = long.join(best, (F.col("ttb_id") == F.col("_id")) & (F.col("field_name") == F.col("_field")), "left")
    p, none = F.coalesce(F.col("b._points"), F.lit(0.0)), F.col("b").isNull()
    ladder = lambda blank, good, fair, poor: F.when(none, blank).when(p >= PASS, good).when(p >= REVIEW, fair).otherwise(poor)
    of = lambda c: F.when(p > 0, F.col(f"b.{c}"))
    return out.select(
        "ttb_id", "at", "field_name", F.when(none, "").otherwise(F.col("expected")).alias("expected"), ladder("not_applicable", "pass", "needs_review", "needs_review").alias("verdict"),
        ladder("no_expected_value", "matched", "ambiguous_match", "not_found").alias("outcome"), F.round(p, 2).alias("score"), of("panel_order").alias("best_panel_order"), of("image_type").alias("best_panel_type"),
        of("filename").alias("best_panel_filename"), text(of("evidence")).alias("evidence_text"), ladder(NO_VALUE, NO_ACTION, AMBIGUOUS, NOT_FOUND).alias("reviewer_action"),
    )


def application_results(wanted: DataFrame, panels: DataFrame, fields: DataFrame) -> DataFrame:
    """A row for each application with a recognised panel: counts of its panels, time, and pass if some field counts and all that do pass."""
    counts = panels.groupBy(F.col("ttb_id").alias("_id")).agg(
        F.count("*").alias("image_count"), F.count("full_text").alias("ocr_image_count"), F.count_if("cache_hit").alias("cache_hit_count"), F.coalesce(F.sum("total_ms"), F.lit(0)).alias("total_ocr_ms"))
    counts = counts.where("ocr_image_count > 0")
    tried = F.col("verdict") != "not_applicable"
    passed = F.coalesce(F.bool_and(F.when(tried, F.col("verdict") == "pass")), F.lit(False))
    said = fields.groupBy(F.col("ttb_id").alias("_of")).agg(F.when(passed, "pass").otherwise("needs_review").alias("overall_verdict"))
    return wanted.select("ttb_id", "status", "source_of_product").join(counts, F.col("ttb_id") == F.col("_id")).join(said, F.col("ttb_id") == F.col("_of")).drop("_id", "_of")


def summary(applications: DataFrame) -> DataFrame:
    """One row: applications by verdict, recognised panels, hits of the cache, mean and largest time of an application."""
    verdict = F.col("overall_verdict")
    return applications.agg(
        F.count("*").alias("application_count"), F.count_if(verdict == "pass").alias("pass_count"), F.count_if(verdict == "needs_review").alias("needs_review_count"), F.coalesce(F.sum("ocr_image_count"), F.lit(0)).alias("image_count"),
        F.coalesce(F.sum("cache_hit_count"), F.lit(0)).alias("cache_hit_count"), F.round(F.avg("total_ocr_ms"), 2).alias("mean_per_application"), F.max("total_ocr_ms").alias("max_per_application"),
    )


def field_summary(fields: DataFrame) -> DataFrame:
    """A row for each field that occurs: attempted, matched, doubtful, match rate and mean score, null where none was attempted."""
    tried, hit = F.col("verdict") != "not_applicable", F.col("verdict") == "pass"
    n = F.count_if(tried)
    return fields.groupBy("field_name").agg(
        n.alias("attempted"), F.count_if(hit).alias("matched"), F.count_if(F.col("verdict") == "needs_review").alias("needs_review"), F.round(F.count_if(hit) / F.nullif(n, F.lit(0)), 4).alias("match_rate"), F.round(F.avg(F.when(tried, F.col("score"))), 2).alias("mean_score"),
    )
