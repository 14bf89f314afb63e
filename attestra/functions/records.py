"""Columns that map records of other sources to this engine's, and facts of recognised blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import overlap
from .text import first_line, label_text, text, unquoted, used_on_label

# Origins that are domestic, units by bucket, the folder that paths are moved from.
DOMESTIC_ORIGINS = ["american", "united states", "usa", "u.s.", "us"]
UNIT_TERMS = {
    "%": ["%", "alc", "vol", "alcohol", "proof"],
    "ml": ["ml", "milliliter", "milliliters"],
    "l": ["l", "liter", "liters"],
    "oz": ["oz", "fl", "fluid", "ounce", "ounces"],
    "pint": ["pint", "pints"],
    "gal": ["gal", "gallon", "gallons"],
}
WORK_FOLDER = "data/work/public-cola"
DECISIONS, NOTED_DECISIONS = ["accept", "reject", "request_correction", "override", "escalate"], ["override", "escalate"]


def product_slug(c: Column) -> Column:
    """The product's slug by keyword, else the text with underscores."""
    low = F.lower(unquoted(c))
    return (
        F.when(low.contains("malt") | low.contains("beer"), "malt_beverage").when(low.contains("spirit") | low.contains("distilled"), "distilled_spirits")
        .when(low.contains("wine"), "wine").otherwise(F.replace(low, F.lit(" "), F.lit("_")))
    )


def form_product(c: Column) -> Column:
    """The same for a form's text, which knows fewer words and falls back to nothing."""
    low = F.lower(text(c))
    return F.when(low.contains("malt"), "malt_beverage").when(low.contains("distilled") | low.contains("spirit"), "distilled_spirits").when(low.contains("wine"), "wine").otherwise("")


def imported_flag(c: Column) -> Column:
    return F.lower(unquoted(c)) == "imported"


def imported(kind: Column, origin: Column) -> Column:
    """What the record says, else whether its origin is named and not domestic."""
    said, named = F.lower(unquoted(kind)), F.lower(unquoted(origin))
    return F.when(said != "", said == "imported").otherwise((named != "") & ~named.isin(DOMESTIC_ORIGINS))


def imported_text(given: Column, bucket: Column) -> Column:
    """``true`` or ``false``: what the application says, else whether its origin's bucket is imported."""
    return F.when(F.coalesce(given, text(bucket) == "imported"), "true").otherwise("false")


def expected_producer(c: Column) -> Column:
    """The name marked as used on the label, else the first line that is not blank."""
    return F.coalesce(F.nullif(used_on_label(c), F.lit("")), first_line(c))


def moved_path(c: Column, root: str) -> Column:
    """A path below the work folder, wherever that was, now below ``root``; other paths stay."""
    below = F.regexp_extract(text(c), rf"^(?:.*/)?{WORK_FOLDER}/(.+)$", 1)
    return F.when(below != "", F.concat(F.lit(root.rstrip("/") + "/"), below)).otherwise(c)


def encoded_link(url: Column) -> Column:
    """A link whose file name is percent-encoded; one without a file name stays as it is."""
    name, kind = F.parse_url(url, F.lit("QUERY"), F.lit("filename")), F.coalesce(F.parse_url(url, F.lit("QUERY"), F.lit("filetype")), F.lit("l"))
    quoted = lambda c: F.replace(F.replace(F.url_encode(F.url_decode(c)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    base = F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")), F.parse_url(url, F.lit("PATH")))
    return F.when(text(name) == "", url).otherwise(F.concat(base, F.lit("?filename="), quoted(name), F.lit("&filetype="), quoted(kind)))


def decision_error(decision: Column, note: Column) -> Column:
    """Why a reviewer's decision is refused; null if it is not."""
    return F.when(~F.coalesce(decision.isin(DECISIONS), F.lit(False)), "Invalid reviewer decision").when(
        decision.isin(NOTED_DECISIONS) & (F.trim(text(note)) == ""), "Override and escalation decisions require a note."
    )


def unit_match(expected: Column, observed: Column) -> Column:
    """1 where a text has a term of a unit that is expected, else 0."""
    want, have = label_text(expected), label_text(observed)
    some = lambda c, terms: reduce(lambda a, b: a | b, [c.contains(t) for t in terms])
    return F.when(reduce(lambda a, b: a | b, [some(want, t) & some(have, t) for t in UNIT_TERMS.values()]), 1.0).otherwise(0.0)


def number_hit(expected: Column, observed: Column) -> Column:
    """1 where a text has the first number that is expected."""
    number = F.regexp_extract(text(expected), r"\d+(?:\.\d+)?", 0)
    return F.when((number != "") & label_text(observed).contains(number), 1.0).otherwise(0.0)


def node_rank(similarity: Column, expected: Column, observed: Column, confidence: Column) -> Column:
    return similarity + 0.25 * overlap(expected, observed) + 0.20 * unit_match(expected, observed) + 0.15 * number_hit(expected, observed) + 0.05 * confidence


def mean_or_zero(values: Column) -> Column:
    """The mean of an array, 0 for none."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)
