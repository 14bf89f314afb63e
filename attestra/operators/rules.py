"""The rule set: one check per rule and item, as columns.

Input rows hold an application's fields (``APPLICATION``), the recognised text
(``full_text``) and its confidence (``avg_confidence``); a ``typography`` struct
(verdict, probability, threshold, crop_available, matched_text) is optional.
:func:`with_checks` adds ``checks``, an array of structs in the order of the
rules; everything is one projection, so nothing is shuffled. Rules that a low
confidence suppresses are left out of the array.

Fuzzy fields are scored by the share of their words that the text has, as
:func:`attestra.functions.evidence.token_score` does, unless a scorer is passed. No arbiter of field support is at hand, so its
"unavailable" branch holds: scores alone decide.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions.text import collapsed, label_text, strip, text

LOW_CONFIDENCE, STRONG, AMBIGUOUS = 0.70, 90, 75
APPLICATION = ["brand_name", "fanciful_name", "class_type", "alcohol_content", "net_contents", "bottler_producer_name_address", "country_of_origin", "imported", "product_type"]
FORM, LAW, WARNING_LAW = ["SRC_TTB_FORM_5100_31", "SRC_STAKEHOLDER_DISCOVERY"], ["SRC_27_CFR_PART_7"], ["SRC_27_USC_215", "SRC_27_CFR_PART_16"]

# Each rule's name, category and sources, in the order of checks.
RULES = {
    "OCR_LOW_CONFIDENCE": ("OCR confidence requires human review", "ocr_quality", ["SRC_STAKEHOLDER_DISCOVERY", "SRC_REPORT_14_HARDENING"]),
    "GOV_WARNING_HEADER_CAPS": ("Government warning heading capitalization", "strict_compliance", ["SRC_27_CFR_PART_16"]),
    "GOV_WARNING_EXACT_TEXT": ("Government warning exact text", "strict_compliance", WARNING_LAW),
    "GOV_WARNING_HEADER_BOLD_REVIEW": ("Government warning heading boldness", "cv_typography", ["SRC_27_CFR_PART_16"]),
    "ALCOHOL_ABV_PROHIBITED": ("Prohibited ABV abbreviation detected", "strict_compliance", LAW),
    "FORM_ALCOHOL_CONTENT_MATCHES_LABEL": ("Application alcohol content matches label artwork", "numeric_match", FORM),
    "MALT_NET_CONTENTS_16OZ_PINT": ("Malt beverage 16 fl. oz. should be 1 Pint", "strict_compliance", LAW),
    "FORM_NET_CONTENTS_MATCHES_LABEL": ("Application net contents match label artwork", "numeric_match", FORM),
    "FORM_BRAND_MATCHES_LABEL": ("Application brand name matches label artwork", "fuzzy_match", FORM),
    "FORM_FANCIFUL_NAME_MATCHES_LABEL": ("Application fanciful name matches label artwork", "fuzzy_match", FORM),
    "FORM_CLASS_TYPE_MATCHES_LABEL": ("Application class/type matches label artwork", "fuzzy_match", FORM),
    "FORM_BOTTLER_NAME_ADDRESS_MATCHES_LABEL": ("Bottler/producer name and address match label artwork", "fuzzy_match", FORM),
    "COUNTRY_OF_ORIGIN_MATCH": ("Country of origin matches imported application field", "field_matching", FORM),
}
WARNING_RULES = ["GOV_WARNING_EXACT_TEXT", "GOV_WARNING_HEADER_CAPS", "GOV_WARNING_HEADER_BOLD_REVIEW"]
FUZZY_FIELDS = {
    "FORM_FANCIFUL_NAME_MATCHES_LABEL": ("fanciful_name", "Fanciful name"),
    "FORM_CLASS_TYPE_MATCHES_LABEL": ("class_type", "Class/type designation"),
    "FORM_BOTTLER_NAME_ADDRESS_MATCHES_LABEL": ("bottler_producer_name_address", "Bottler/producer name and address"),
}

Outcome = tuple[Column, str, str, Column, str | None]


class Check(NamedTuple):
    """A rule's columns; all are null where the rule does not run."""

    rule_id: str
    verdict: Column
    message: Column
    observed: Column
    whole: Column
    #: The message where a verdict is known already.
    reasons: dict[str, Column]


def ladder(rule_id: str, outcomes: list[Outcome], expected: Column, evidence: Column, score: Column | None = None, confidence: Column | None = None, emit: Column | None = None) -> Check:
    """A check whose first outcome that holds decides: (condition, verdict, message, observed, reviewer's action)."""
    name, category, sources = RULES[rule_id]

    def chosen(values: list[Column]) -> Column:
        out = values[-1]
        for (condition, *_), value in zip(reversed(outcomes[:-1]), reversed(values[:-1]), strict=True):
            out = F.when(condition, value).otherwise(out)
        return out

    out = F.struct(
        F.lit(list(RULES).index(rule_id)).alias("ord"), F.lit(rule_id).alias("rule_id"), F.lit(name).alias("name"), F.lit(category).alias("category"),
        chosen([F.lit(o[1]) for o in outcomes]).alias("verdict"), chosen([F.lit(o[2]) for o in outcomes]).alias("message"),
        expected.alias("expected"), chosen([o[3].cast("string") for o in outcomes]).alias("observed"), evidence.alias("evidence_text"),
        chosen([F.lit(o[4]).cast("string") for o in outcomes]).alias("reviewer_action"), F.array(*map(F.lit, sources)).alias("source_refs"),
        (score if score is not None else F.lit(None)).cast("double").alias("score"), (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"),
    )
    only = (lambda c: c) if emit is None else (lambda c: F.when(emit, c))
    # The first outcome that holds is the first of its verdict's that does.
    reasons = {v: F.coalesce(*[F.when(o[0], F.lit(o[2])) for o in same[:-1]], F.lit(same[-1][2])) for v in dict.fromkeys(o[1] for o in outcomes) if (same := [o for o in outcomes if o[1] == v])}
    return Check(rule_id, only(chosen([F.lit(o[1]) for o in outcomes])), only(chosen([F.lit(o[2]) for o in outcomes])), only(chosen([o[3].cast("string") for o in outcomes])), only(out), reasons)


def _numeric(rule_id: str, field: str, what: str, none: str, kind: str, shown: Column, action: str, evidence: Column, confidence: Column, low: Column) -> Check:
    """The ladder that alcohol and net contents share; ``kind`` names their facts."""
    given = F.col(f"_given_{field}")
    want, have, met = F.col(f"_want_{kind}"), F.col(f"_seen_{kind}"), F.col(f"_met_{kind}")
    plain = what.lower().replace("-", " ")
    return ladder(
        rule_id,
        [
            (given == "", "pass", f"{what} comparison skipped because no application value was provided.", F.lit(f"No application {plain}"), None),
            (F.size(want) == 0, "needs_review", f"Application {plain} could not be parsed for automated comparison.", F.lit(f"No parseable application {none}"), f"Review the {what.lower()} application field and label manually."),
            (low, "needs_review", f"OCR confidence is too low to verify the {what.lower()} statement.", F.format_string("OCR confidence %.2f", confidence), f"Review the {what.lower()} statement manually."),
            (met, "pass", f"{what} value appears to match the application field.", shown, None),
            (F.size(have) > 0, "fail", f"{what} value on the label does not match the application field.", shown, action),
            (F.lit(True), "needs_review", f"No clear {what.lower()} value was found in OCR text.", F.lit(f"No label {what.lower()} value found"), f"Review the label {what.lower()} statement manually."),
        ],
        F.when(given == "", f"Application {plain} when provided").otherwise(given),
        F.when(given == "", F.lit(None)).when(F.size(want) == 0, F.substring(evidence, 1, 500)).otherwise(evidence), confidence=confidence, emit=~low,
    )


#: Fields of an application that are compared without white space at their ends.
GIVEN = ["alcohol_content", "net_contents", *[f for f, _ in FUZZY_FIELDS.values()], "country_of_origin"]


def with_parts(items: DataFrame, full_text: str = "full_text") -> DataFrame:
    """The warning's part of a text and the rest, found once: ``_heading``, ``_block``, and ``_front``, which amounts and countries are looked for in.

    The front is a text without the required warning at its end, which states neither; ``_cut`` says that it was there.
    Without a blank before the warning, or with another one, the text stays whole.
    """
    body, before, heading = text(F.col(full_text)), F.col("_before"), F.col("_heading")
    cut = items.withColumn("_before", F.substring_index(body, ev.WARNING.partition(" (")[0], 1)).withColumn("_heading", ev.first_heading(body, before))
    cut = cut.withColumn("_before", F.call_function("substring_index", body, heading, F.lit(1))).withColumn("_block", ev.block_behind(body, before, heading))
    cut = cut.withColumn("_cut", F.coalesce(F.col("_block") == ev.WARNING, F.lit(False)) & ((before == "") | F.endswith(before, F.lit(" "))))
    return cut.withColumn("_front", F.when(F.col("_cut"), before).otherwise(body)).drop("_before")


def with_plain(parts: DataFrame) -> DataFrame:
    """``_padded``: the front of :func:`with_parts` in its plain form, a blank at each end, which words are looked for in."""
    return parts.withColumn("_padded", F.concat(F.lit(" "), label_text(F.col("_front")), F.lit(" ")))


def with_facts(items: DataFrame, score: Callable[[Column, Column], Column] | None) -> DataFrame:
    """What several outcomes ask for, worked out once per item: columns named ``_...``.

    The text's plain form comes first, as all token scores share it, with the part from the warning's heading on
    and the fields without white space at their ends.
    """
    body, country, front, padded, cut = text(F.col("full_text")), F.col("_given_country_of_origin"), F.col("_front"), F.col("_padded"), F.col("_cut")
    given = {f: F.col(f"_given_{f}") for f in GIVEN} | {"brand_name": F.col("brand_name")}
    plain = with_plain(with_parts(items.withColumns({f"_given_{f}": strip(F.col(f)) for f in GIVEN})))
    words = {} if score else {f"_words_{f}": label_text(given[f]) for f in ["brand_name", *[f for f, _ in FUZZY_FIELDS.values()]]}
    plain = plain.withColumns({"_own": label_text(country), "_named": ev.named_countries(padded)} | words)

    def scored(f: str) -> Column:
        return score(given[f], body) if score else ev.phrase_score(F.col(f"_words_{f}"), padded, cut)

    def of_country(expected: Column, _: Column) -> Column:
        return score(expected, body) if score else ev.phrase_score(F.col("_own"), padded, cut)

    first = plain.withColumns({
        "_shorthand": ev.abv_shorthand(front), "_sixteen": ev.bad_sixteen_ounces(front),
        "_want_alcohol": ev.alcohol_values(given["alcohol_content"]), "_seen_alcohol": ev.alcohol_values(front),
        "_want_contents": ev.contents_values(given["net_contents"]), "_seen_contents": ev.contents_values(front),
        "_brand": scored("brand_name"), **{f"_score_{f}": scored(f) for f, _ in FUZZY_FIELDS.values()},
        "_country": ev.country_score(country, body, of_country, None if score else lambda o: ev.known_score(o, padded, cut)), "_other": ev.conflicting_country(F.col("_own"), F.col("_named")),
    })
    return first.withColumns({"_met_alcohol": ev.alcohol_match(F.col("_want_alcohol"), F.col("_seen_alcohol")), "_met_contents": ev.contents_match(F.col("_want_contents"), F.col("_seen_contents"))})


def check_columns(has_typography: bool = False) -> list[Check]:
    """The checks in order, from the facts; null where a rule does not run."""
    body, confidence = text(F.col("full_text")), F.col("avg_confidence").cast("double")
    low, always = confidence < LOW_CONFIDENCE, F.lit(True)
    out = [
        ladder("OCR_LOW_CONFIDENCE", [(always, "needs_review", "OCR confidence is below the threshold for deterministic review.", F.format_string("%.2f", confidence), "Review the label image manually or request a clearer image.")],
               F.lit(f">= {LOW_CONFIDENCE:.2f}"), F.substring(body, 1, 500), confidence=confidence, emit=low),
    ]
    heading, block = F.col("_heading"), F.col("_block")
    out.append(ladder("GOV_WARNING_HEADER_CAPS", [
        (heading == "GOVERNMENT WARNING:", "pass", "Government warning heading is all caps.", heading, None),
        (always, "fail", "Government warning heading is not in the required all-caps form.", heading, "Change the warning heading to GOVERNMENT WARNING:"),
    ], F.lit("GOVERNMENT WARNING:"), heading, emit=~low))
    out.append(ladder("GOV_WARNING_EXACT_TEXT", [
        (block.isNull(), "needs_review", "Government warning block could not be isolated reliably.", F.lit(None), "Review the label warning manually."),
        (block == ev.WARNING, "pass", "Government warning text matches the required wording.", block, None),
        (always, "fail", "Government warning text does not match the canonical wording.", block, "Correct the warning text and punctuation."),
    ], F.lit(ev.WARNING), block, emit=~low))
    bold_pass, bold_score, given = F.lit(False), F.lit(None), F.lit(False)
    bold_seen, bold_other = F.lit("Raster image typography not machine-certified"), F.lit("Raster image typography not machine-certified")
    bold_text = text(heading)
    if has_typography:
        t = F.col("typography")
        given, bold_pass, bold_score = t.isNotNull(), F.coalesce(t["verdict"] == "pass", F.lit(False)), t["probability"]
        bold_seen = F.concat(F.lit("bold_probability="), text(t["probability"].cast("string")), F.lit("; threshold="), text(t["threshold"].cast("string")))
        bold_other = F.when(given, F.concat(bold_seen, F.lit("; crop_available="), text(F.initcap(t["crop_available"].cast("string"))))).otherwise(bold_other)
        bold_text = F.coalesce(F.nullif(t["matched_text"], F.lit("")), bold_text)
    out.append(ladder("GOV_WARNING_HEADER_BOLD_REVIEW", [
        (bold_pass, "pass", "Government warning heading is confidently classified as bold.", bold_seen, None),
        (always, "needs_review", "Manual typography verification required. The warning heading was not confidently cleared as bold.", bold_other, "Confirm the warning heading is bold before clearing this application."),
    ], F.lit("Bold GOVERNMENT WARNING heading"), bold_text, bold_score, confidence, emit=low | given))
    shorthand = F.col("_shorthand")
    out.append(ladder("ALCOHOL_ABV_PROHIBITED", [
        (shorthand.isNotNull(), "fail", "Alcohol-content shorthand ABV detected.", shorthand, "Replace ABV shorthand with acceptable alcohol-content wording."),
        (always, "pass", "No prohibited ABV shorthand detected.", shorthand, None),
    ], F.lit("Use ALC/VOL or Alcohol by Volume wording where applicable."), shorthand, emit=~low))
    percents = F.array_join(F.transform("_seen_alcohol", lambda x: F.concat(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("% ABV"))), ", ")
    out.append(_numeric("FORM_ALCOHOL_CONTENT_MATCHES_LABEL", "alcohol_content", "Alcohol-content", "alcohol value", "alcohol", percents, "Correct the application alcohol content or the label artwork.", body, confidence, low))
    malt = (F.col("product_type") == "malt_beverage") & F.col("_sixteen")
    out.append(ladder("MALT_NET_CONTENTS_16OZ_PINT", [
        (malt, "fail", "Malt beverage net contents use 16 fl. oz. where 1 Pint is expected.", F.lit("16 fl. oz."), "Express the net contents as 1 Pint."),
        (always, "pass", "No malt 16 fl. oz. net-contents issue detected.", F.col("net_contents"), None),
    ], F.lit("1 Pint"), body, emit=~low))
    amounts = F.array_join(F.transform("_seen_contents", lambda x: x["evidence"]), ", ")
    out.append(_numeric("FORM_NET_CONTENTS_MATCHES_LABEL", "net_contents", "Net-contents", "net contents", "contents", amounts, "Correct the application net contents or the label artwork.", body, confidence, low))
    brand = F.col("_brand")
    window = F.lit("OCR text window")
    out.append(ladder("FORM_BRAND_MATCHES_LABEL", [
        (brand >= STRONG, "pass", "Brand name appears to match the application field.", window, None),
        ((brand >= AMBIGUOUS) | low, "needs_review", "Brand name match is ambiguous.", window, "Review the brand field and label artwork manually."),
        (always, "fail", "Brand name on label does not clearly match application field.", window, "Correct the application field or label artwork."),
    ], F.col("brand_name"), body, brand, confidence, emit=~low))
    for rule_id, (field, label) in FUZZY_FIELDS.items():
        given_value = F.col(f"_given_{field}")
        s = F.col(f"_score_{field}")
        out.append(ladder(rule_id, [
            (given_value == "", "pass", f"{label} comparison skipped because no application value was provided.", F.lit(f"No application {label.lower()}"), None),
            (s >= STRONG, "pass", f"{label} appears to match the application field.", window, None),
            ((s >= AMBIGUOUS) | low, "needs_review", f"{label} match is ambiguous.", window, f"Review the {label.lower()} field and label artwork manually."),
            (always, "fail", f"{label} on label does not clearly match application field.", window, f"Correct the application {label.lower()} or label artwork."),
        ], F.when(given_value == "", f"{label} when provided").otherwise(given_value), F.when(given_value != "", body), F.when(given_value != "", s), confidence, emit=~low))
    country = F.col("_given_country_of_origin")
    s, other = F.col("_country"), F.col("_other")
    out.append(ladder("COUNTRY_OF_ORIGIN_MATCH", [
        (~F.coalesce(F.col("imported"), F.lit(False)), "pass", "Country-of-origin check skipped because the application is not marked imported.", F.lit("Application marked domestic/not imported"), None),
        (country == "", "needs_review", "Imported product is missing a country-of-origin application field.", F.lit("Blank application country_of_origin"), "Enter the expected country of origin or review the label manually."),
        (low, "needs_review", "OCR confidence is too low to verify the country-of-origin statement.", F.format_string("OCR confidence %.2f", confidence), "Review the country-of-origin statement manually."),
        (s >= STRONG, "pass", "Country-of-origin statement appears to match the application field.", F.lit("Country found in OCR text"), None),
        (other.isNotNull(), "fail", "A conflicting country-of-origin statement appears on the label.", other, "Correct the label origin statement or the application country-of-origin field."),
        (always, "needs_review", "Expected country of origin was not found with enough confidence.", F.lit("No clear country-of-origin match in OCR text"), "Review the imported product origin statement manually."),
    ], F.when(~F.coalesce(F.col("imported"), F.lit(False)), "Imported product origin statement when imported is true").when(country == "", "Declared country of origin").otherwise(country),
        F.when(~F.coalesce(F.col("imported"), F.lit(False)), F.lit(None)).when((country == "") | low, F.substring(body, 1, 500)).otherwise(body),
        F.when(F.coalesce(F.col("imported"), F.lit(False)) & (country != "") & ~low, s), confidence))
    return out


def with_checks(items: DataFrame, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``items`` with ``checks``, in the order of the rules."""
    facts = with_facts(items, score)
    checked = facts.withColumn("checks", F.array_compact(F.array(*[c.whole for c in check_columns("typography" in items.columns)])))
    return checked.select(*items.columns, "checks")


def judged(items: DataFrame, score: Callable[[Column, Column], Column] | None = None, review_unknown_warning: bool = False, review_before_rejection: bool = False, review_before_acceptance: bool = False) -> DataFrame:
    """What :func:`with_verdicts` adds, straight from the rules' verdicts as plain columns, without ``checks``."""
    checks = check_columns("typography" in items.columns)
    facts = with_facts(items, score)
    plain = facts.withColumns({f"_v{i}": c.verdict for i, c in enumerate(checks)})
    said = [F.col(f"_v{i}") for i in range(len(checks))]

    def some(value: str, rules: list[str] | None = None) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(v == value, F.lit(False)) for v, c in zip(said, checks, strict=True) if rules is None or c.rule_id in rules])

    def first(value: str) -> list[Column]:
        return [F.when(v == value, c.reasons[value]) for v, c in zip(said, checks, strict=True) if value in c.reasons]

    def ids(holds: Callable[[Column], Column]) -> Column:
        # Rules are there once each, so nothing but nulls goes; unlike a filter this is compiled.
        return F.array_except(F.array(*[F.when(holds(v), c.rule_id) for v, c in zip(said, checks, strict=True)]), F.array(F.lit(None).cast("string")))

    failing, unclear, unknown = some("fail"), some("needs_review"), some("needs_review", WARNING_RULES)
    verdict = F.when(failing, "fail").when(unclear, "needs_review").otherwise("pass")
    out = plain.withColumns({"overall_verdict": verdict, "_unknown": unknown}).withColumns({
        "policy_queue": policy_queue(F.col("overall_verdict"), F.col("_unknown"), review_unknown_warning, review_before_rejection, review_before_acceptance),
        "top_reason": F.coalesce(*first("fail"), *first("needs_review"), F.lit(ALL_PASSED)),
        "checked_rule_ids": ids(lambda v: v.isNotNull()), "triggered_rule_ids": ids(lambda v: v.isin("fail", "needs_review")),
    })
    return out.select(*items.columns, "overall_verdict", "policy_queue", "top_reason", "checked_rule_ids", "triggered_rule_ids")


ALL_PASSED = "All implemented checks passed."


def policy_queue(verdict: Column, unknown: Column, review_unknown_warning: bool, review_before_rejection: bool, review_before_acceptance: bool) -> Column:
    """Where an item goes; an unclear warning decides before the verdict does."""
    reject = "rejection_review" if review_before_rejection else "ready_to_reject"
    accept = "acceptance_review" if review_before_acceptance else "ready_to_accept"
    return F.when(unknown, "manual_evidence_review" if review_unknown_warning else reject).when(verdict == "pass", accept).when(verdict == "fail", reject).otherwise("manual_evidence_review")


def with_verdicts(checked: DataFrame, review_unknown_warning: bool = False, review_before_rejection: bool = False, review_before_acceptance: bool = False) -> DataFrame:
    """Adds the roll-up of ``checks``: verdict, queue, top reason, checked and triggered rule ids."""
    checks = F.col("checks")
    failing = F.filter(checks, lambda c: c["verdict"] == "fail")
    unclear = F.filter(checks, lambda c: c["verdict"] == "needs_review")
    verdict = F.when(F.size(failing) > 0, "fail").when(F.size(unclear) > 0, "needs_review").otherwise("pass")
    unknown = F.exists(unclear, lambda c: c["rule_id"].isin(WARNING_RULES))
    queue = policy_queue(verdict, unknown, review_unknown_warning, review_before_rejection, review_before_acceptance)
    reason = F.coalesce(F.try_element_at(failing, F.lit(1))["message"], F.try_element_at(unclear, F.lit(1))["message"], F.lit(ALL_PASSED))
    ids = lambda a: F.transform(a, lambda c: c["rule_id"])
    return checked.withColumns({
        "overall_verdict": verdict, "policy_queue": queue, "top_reason": reason,
        "checked_rule_ids": ids(checks), "triggered_rule_ids": ids(F.filter(checks, lambda c: c["verdict"].isin("fail", "needs_review"))),
    })


#: Columns of the results file, and where they come from if not from a column of that name.
RESULT_COLUMNS = {
    "filename": None, "raw_verdict": "overall_verdict", "overall_verdict": None, "policy_queue": None, "top_reason": None, "checked_rule_ids": "list", "triggered_rule_ids": "list",
    "expected_values": "check:expected", "observed_values": "check:observed", "evidence_text": "check:evidence_text", "reviewer_actions": "check:reviewer_action",
    "reviewer_decision": None, "reviewer_note": None, "reviewed_at": None, "ocr_source": None, "ocr_confidence": "avg_confidence", "processing_ms": None,
}


def result_rows(verdicts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of the results file per item, all or some of its columns: lists joined by ``;``, the checks' values as ``rule: value`` joined by `` | ``."""

    def made(name: str, source: str | None) -> Column:
        if source == "list":
            return F.array_join(name, ";")
        if source and source.startswith("check:"):
            field = source.partition(":")[2]
            some = F.filter(F.col("checks"), lambda c: F.coalesce(c[field], F.lit("")) != "")
            return F.array_join(F.transform(some, lambda c: F.concat(c["rule_id"], F.lit(": "), F.substring(F.replace(c[field], F.lit("\n"), F.lit(" ")), 1, 500))), " | ")
        found = next((c for c in (name, source) if c in verdicts.columns), None)
        return F.coalesce(F.col(found).cast("string"), F.lit("")) if found else F.lit("")

    return verdicts.select(*[made(c, source).alias(c) for c, source in RESULT_COLUMNS.items() if columns is None or c in columns])


def zero_filled(counts: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Counts by ``key`` with a row for each of a short list of keys."""
    spec = counts.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], f"ord int, {key} string")
    return F.broadcast(spec).join(counts.groupBy(key).agg(F.count("*").alias("n")), key, "left").select("ord", key, F.coalesce("n", F.lit(0)).alias("n"))


QUEUES = ["ready_to_accept", "acceptance_review", "manual_evidence_review", "rejection_review", "ready_to_reject"]


def compared(items: DataFrame, fields: dict[str, str]) -> DataFrame:
    """What :func:`comparison_rows` gives, straight from the rules' outcomes of these fields, without ``checks``."""
    checks = {c.rule_id: c for c in check_columns("typography" in items.columns)}
    value = lambda f: F.col(f).cast("string")
    shown = lambda f: F.when(strip(value(f)) == "", "Not provided").otherwise(collapsed(value(f)))
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), shown(f).alias("application_value"), F.coalesce(checks[r].verdict, F.lit("not_checked")).alias("verdict"), F.coalesce(checks[r].observed, F.lit("")).alias("observed"))
        for i, (f, r) in enumerate(fields.items())
    ]
    return with_facts(items, None).select("item_id", F.explode(F.array(*rows)).alias("s")).select("item_id", "s.*")


def compared_counts(items: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows of :func:`compared` by field and verdict (``n``), and those with a blank application value (``blank``).

    Items that are alike in all fields are counted first, so that a few kinds of items become rows, not every item.
    """
    checks = {c.rule_id: c for c in check_columns("typography" in items.columns)}
    said = [F.coalesce(checks[r].verdict, F.lit("not_checked")).alias(f"verdict_{i}") for i, r in enumerate(fields.values())]
    blank = [(strip(F.col(f).cast("string")) == "").alias(f"blank_{i}") for i, f in enumerate(fields)]
    kinds = with_facts(items, None).select(*said, *blank)
    kinds = kinds.groupBy(*kinds.columns).agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(f"verdict_{i}").alias("verdict"), F.col("n"), F.when(F.col(f"blank_{i}"), F.col("n")).otherwise(0).alias("blank")) for i, f in enumerate(fields)]
    return kinds.select(F.explode(F.array(*rows)).alias("s")).select("s.*").groupBy("ord", "field", "verdict").agg(F.sum("n").alias("n"), F.sum("blank").alias("blank"))


def comparison_rows(verdicts: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row per item and displayed field: the application's value against what its rule observed."""
    spec = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(field).alias("field"), F.lit(rule).alias("rule_id"), F.col(field).cast("string").alias("value")) for i, (field, rule) in enumerate(fields.items())]))
    rows = verdicts.select("item_id", "checks", spec.alias("s"))
    check = F.try_element_at(F.filter("checks", lambda c: c["rule_id"] == F.col("s.rule_id")), F.lit(1))
    shown = F.when(strip(F.col("s.value")) == "", "Not provided").otherwise(collapsed(F.col("s.value")))
    return rows.select("item_id", "s.ord", "s.field", shown.alias("application_value"), F.coalesce(check["verdict"], F.lit("not_checked")).alias("verdict"), F.coalesce(check["observed"], F.lit("")).alias("observed"))
