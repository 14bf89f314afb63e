"""What a photographed label seems to say: lines of text, and a candidate for each field of an application."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound, collapsed, evidence_window, text

# Patterns and lists of the intake, which differ from those of the rules.
ALCOHOL = r"(?i)\b(?:alcohol\s*)?(\d{1,3}(?:\.\d{1,2})?)\s*%?\s*(alc\.?\s*/?\s*vol\.?|alcohol\s+by\s+volume|abv|a\.?b\.?v\.?|by\s+vol\.?)\b"
PERCENT = r"\b(\d{1,3}(?:\.\d{1,2})?)\s*%\b"
PROOF = r"(?i)\b(\d{2,3}(?:\.\d+)?)\s*proof\b"
CONTENTS = r"(?i)\b(\d+(?:\.\d+)?)\s*(ml|milliliters?|l|liters?|litres?|fl\.?\s*oz\.?|fluid\s+ounces?|oz\.?|pints?|pt\.?|gallons?|gal\.?)\b"
NO_BRAND = r"(?i)(government warning|net contents|alc|alcohol|surgeon general|pregnancy|birth defects|contains sulfites)"
CLASSES = ["ale", "beer", "lager", "stout", "porter", "ipa", "wine", "red wine", "white wine", "table wine", "sparkling wine", "cabernet", "chardonnay", "merlot", "pinot", "riesling", "bourbon", "whiskey", "whisky", "vodka", "gin", "rum", "tequila", "mezcal", "brandy", "liqueur", "hard cider"]
SPIRITS = ["whiskey", "whisky", "vodka", "gin", "rum", "tequila", "mezcal", "bourbon", "brandy"]
MALT = ["beer", "ale", "lager", "stout", "porter", "ipa"]
WINES = ["wine", "chardonnay", "cabernet", "merlot", "pinot", "riesling"]
COUNTRIES = ["argentina", "australia", "austria", "canada", "chile", "france", "germany", "ireland", "italy", "japan", "mexico", "new zealand", "portugal", "scotland", "south africa", "spain", "united kingdom"]
CONFIDENCE = {"brand_name": 0.55, "product_type": 0.6, "class_type": 0.62, "class_type_anywhere": 0.45, "alcohol": 0.82, "percent": 0.55, "proof": 0.65, "net_contents": 0.75, "country_of_origin": 0.55}
#: Blocks whose tops differ by no more stand on one line.
SAME_LINE = 0.015


def _any_of(c: Column, terms: list[str]) -> Column:
    return c.rlike("|".join(terms))


def lines_of(full_text: Column) -> Column:
    return F.filter(F.transform(F.split(text(full_text), r"\r\n|\r|\n"), lambda x: collapsed(x)), lambda x: x != "")


def grouped_lines(blocks: list[dict]) -> list[str]:
    """Lines from blocks by position: each joins the first line whose top is near; without positions, a block is a line."""
    clean = [(" ".join((b["text"] or "").split()), b["bbox"]) for b in blocks]
    if not all(box is not None and len(box) and box[0] is not None and len(box[0]) >= 2 for _, box in clean):
        return [t for t, _ in clean if t]
    found: list[tuple[float, list[tuple[float, str]]]] = []
    for (y, x), t in sorted(((float(box[0][1]), float(box[0][0])), t) for t, box in clean):
        if t:
            row = next((words for top, words in found if abs(y - top) <= SAME_LINE), None)
            if row is None:
                found.append((y, row := []))
            row.append((x, t))
    return [" ".join(t for _, t in sorted(words)) for _, words in found]


def with_lines(ocr: DataFrame) -> DataFrame:
    """``ocr`` with ``lines``: from its blocks if there are any, else from its text. Grouping depends on order, hence Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            made = [grouped_lines(list(b)) if b is not None and len(b) else [] for b in df["blocks"]]
            yield df.assign(_made=made)

    made = ocr.mapInPandas(run, ocr.selectExpr("*", "cast(null as array<string>) as _made").schema)
    return made.withColumn("lines", F.when(F.size("_made") > 0, F.col("_made")).otherwise(lines_of(F.col("full_text")))).drop("_made")


def _candidate(value: Column, confidence: Column | float, evidence: Column) -> Column:
    grade = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), grade.cast("double").alias("confidence"), evidence.alias("evidence")))


def _first_named(low: Column, terms: list[str]) -> Column:
    """The first term that a text has; the text is bound, as it would else be worked out for each term."""
    return bound(low, lambda b: F.try_element_at(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(b, t)), F.lit(1)))


def contents_value(full_text: Column) -> Column:
    """The value alone of :func:`candidates`' ``net_contents``; likewise the next two."""
    return F.nullif(collapsed(F.regexp_extract(text(full_text), CONTENTS, 0)), F.lit(""))


def country_value(full_text: Column) -> Column:
    return F.initcap(_first_named(F.lower(text(full_text)), COUNTRIES))


def alcohol_value(full_text: Column) -> Column:
    return _alcohol(text(full_text))[0]


def _alcohol(body: Column) -> tuple[Column, Column, Column, Column]:
    """The strength that a text states, and the three texts it may come from."""
    hit, percent, proof = F.regexp_extract(body, ALCOHOL, 0), F.regexp_extract(body, PERCENT, 0), F.regexp_extract(body, PROOF, 0)
    strength = F.regexp_extract(body, PROOF, 1)
    halved = F.regexp_replace((F.try_to_number(strength, F.lit("999.99")).cast("double") / 2).cast("string"), r"\.0$", "")
    value = F.when(hit != "", collapsed(hit)).when(percent != "", F.concat(F.regexp_extract(body, PERCENT, 1), F.lit("%"))).when(proof != "", F.concat(strength, F.lit(" proof (~"), halved, F.lit("% ALC/VOL)")))
    return value, hit, percent, proof


def candidates(lines: Column, full_text: Column) -> dict[str, Column]:
    """A struct (value, confidence, evidence) for each field, null where nothing is found."""
    body = text(full_text)
    low = F.lower(body)

    def brand_like(x: Column) -> Column:
        letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
        return ~x.rlike(NO_BRAND) & ~x.rlike(CONTENTS) & ~x.rlike(ALCOHOL) & F.length(x).between(3, 80) & (letters >= 3) & ~F.lower(x).isin(CLASSES)

    brand = F.try_element_at(F.filter(F.slice(lines, 1, 8), brand_like), F.lit(1))
    kind = F.when(_any_of(low, SPIRITS), "distilled_spirits").when(_any_of(low, MALT), "malt_beverage").when(_any_of(low, WINES), "wine")
    by_line = F.try_element_at(F.filter(lines, lambda x: _any_of(F.lower(x), CLASSES)), F.lit(1))
    anywhere = _first_named(low, CLASSES)
    alcohol, hit, percent, proof = _alcohol(body)
    grade = F.when(hit != "", CONFIDENCE["alcohol"]).when(percent != "", CONFIDENCE["percent"]).otherwise(CONFIDENCE["proof"])
    shown = F.when(hit != "", hit).when(percent != "", percent).otherwise(proof)
    contents = F.nullif(F.regexp_extract(body, CONTENTS, 0), F.lit(""))
    country = _first_named(low, COUNTRIES)
    return {
        "brand_name": _candidate(brand, CONFIDENCE["brand_name"], brand),
        "product_type": _candidate(kind, CONFIDENCE["product_type"], evidence_window(body, F.replace(kind, F.lit("_"), F.lit(" ")), 60)),
        "class_type": F.coalesce(_candidate(by_line, CONFIDENCE["class_type"], by_line), _candidate(F.initcap(anywhere), CONFIDENCE["class_type_anywhere"], evidence_window(body, anywhere, 60))),
        "alcohol_content": _candidate(alcohol, grade, evidence_window(body, shown, 60)),
        "net_contents": F.when(contents.isNotNull(), _candidate(collapsed(contents), CONFIDENCE["net_contents"], evidence_window(body, contents, 60))),
        "country_of_origin": _candidate(F.initcap(country), CONFIDENCE["country_of_origin"], evidence_window(body, country, 60)),
    }
