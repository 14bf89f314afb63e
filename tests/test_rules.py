from __future__ import annotations

from pyspark.sql import functions as F

import pytest

from attestra.functions import evidence as ev
from attestra.functions import similarity, text
from attestra.operators import rules
from attestra.sources import sinks

MALT = {"product_type": "malt_beverage", "brand_name": "OLD RIVER BREWING", "class_type": "Ale", "alcohol_content": "5% ALC/VOL", "net_contents": "1 Pint", "country_of_origin": None, "imported": False}
WINE = {"product_type": "wine", "brand_name": "VALLEY RIDGE", "class_type": "Red Wine", "alcohol_content": "13.5% ALC/VOL", "net_contents": "750 mL", "country_of_origin": "France", "imported": True}
COLUMNS = "item_id string, filename string, product_type string, brand_name string, fanciful_name string, class_type string, alcohol_content string, net_contents string, bottler_producer_name_address string, country_of_origin string, imported boolean, avg_confidence double, full_text string, total_ms int"


def malt(brand="OLD RIVER BREWING", alcohol="5% ALC/VOL", contents="1 Pint", warning=ev.WARNING):
    return "\n".join(x for x in (brand, "ALE", alcohol, f"NET CONTENTS {contents}", warning) if x)


def wine(origin):
    return f"VALLEY RIDGE\nRED WINE\n13.5% ALC/VOL\nNET CONTENTS 750 mL\nPRODUCT OF {origin}\n{ev.WARNING}"


# Golden items, their text and confidence, the verdict and what must be triggered.
GOLDEN = {
    "clean_malt_pass": (MALT, malt(), 0.98, "pass", []),
    "brand_case_difference_pass": (MALT, malt(brand="Old River Brewing"), 0.98, "pass", []),
    "imported_country_origin_pass": (WINE, wine("FRANCE"), 0.98, "pass", []),
    "warning_missing_comma_fail": (MALT, malt(warning=ev.WARNING.replace("machinery, and", "machinery and")), 0.98, "fail", ["GOV_WARNING_EXACT_TEXT"]),
    "warning_title_case_fail": (MALT, malt(warning=ev.WARNING.replace("GOVERNMENT WARNING", "Government Warning")), 0.98, "fail", ["GOV_WARNING_HEADER_CAPS", "GOV_WARNING_EXACT_TEXT"]),
    "abv_prohibited_fail": (MALT, malt(alcohol="5% ABV"), 0.98, "fail", ["ALCOHOL_ABV_PROHIBITED"]),
    "malt_16_fl_oz_fail": (MALT, malt(contents="16 fl. oz."), 0.98, "fail", ["MALT_NET_CONTENTS_16OZ_PINT"]),
    "brand_mismatch_fail": (MALT | {"brand_name": "PHANTOM CELLARS"}, malt(), 0.98, "fail", ["FORM_BRAND_MATCHES_LABEL"]),
    "conflicting_country_origin_fail": (WINE, wine("ITALY"), 0.98, "fail", ["COUNTRY_OF_ORIGIN_MATCH"]),
    "imported_missing_country_review": (WINE | {"country_of_origin": ""}, wine("FRANCE"), 0.98, "needs_review", ["COUNTRY_OF_ORIGIN_MATCH"]),
    "low_confidence_blur_review": (MALT, malt(), 0.42, "needs_review", ["OCR_LOW_CONFIDENCE", "GOV_WARNING_HEADER_BOLD_REVIEW"]),
    "warning_missing_block_review": (MALT, malt(warning=""), 0.66, "needs_review", ["OCR_LOW_CONFIDENCE", "GOV_WARNING_HEADER_BOLD_REVIEW"]),
}


def items(spark, cases: dict):
    rows = [(n, f"{n}.png", a["product_type"], a["brand_name"], "", a["class_type"], a["alcohol_content"], a["net_contents"], "", a["country_of_origin"], a["imported"], c, t, 5) for n, (a, t, c, *_) in cases.items()]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.mark.parametrize("score", [None, similarity.partial_score])
def test_golden_items(spark, score):
    out = rules.with_verdicts(rules.with_checks(items(spark, GOLDEN), score)).collect()
    for r in out:
        _, _, _, verdict, triggered = GOLDEN[r.item_id]
        assert r.overall_verdict == verdict, r.item_id
        assert set(triggered) <= set(r.triggered_rule_ids), r.item_id
    low = next(r for r in out if r.item_id == "low_confidence_blur_review")
    assert low.checked_rule_ids == ["OCR_LOW_CONFIDENCE", "GOV_WARNING_HEADER_BOLD_REVIEW", "COUNTRY_OF_ORIGIN_MATCH"] and low.policy_queue == "ready_to_reject"


def test_queues_and_typography(spark):
    from pyspark.sql import functions as F

    df = rules.with_checks(items(spark, GOLDEN))
    gated = {r.item_id: r.policy_queue for r in rules.with_verdicts(df, True, True, True).collect()}
    assert gated["clean_malt_pass"] == "acceptance_review" and gated["brand_mismatch_fail"] == "rejection_review"
    assert gated["low_confidence_blur_review"] == "manual_evidence_review" == gated["imported_missing_country_review"]
    plain = {r.item_id: r.policy_queue for r in rules.with_verdicts(df).collect()}
    assert plain["clean_malt_pass"] == "ready_to_accept" and plain["brand_mismatch_fail"] == "ready_to_reject"
    bold = F.struct(F.lit("pass").alias("verdict"), F.lit(0.99).alias("probability"), F.lit(0.95).alias("threshold"), F.lit(True).alias("crop_available"), F.lit("GOVERNMENT WARNING").alias("matched_text"))
    checks = rules.with_checks(items(spark, GOLDEN).withColumn("typography", bold)).select(F.inline_outer("checks")).where("rule_id = 'GOV_WARNING_HEADER_BOLD_REVIEW'").collect()
    assert len(checks) == len(GOLDEN) and {(c.verdict, c.score) for c in checks} == {("pass", 0.99)}
    counts = rules.zero_filled(rules.with_verdicts(df), "policy_queue", rules.QUEUES).orderBy("ord").collect()
    assert [c.policy_queue for c in counts] == rules.QUEUES and sum(c.n for c in counts) == len(GOLDEN) and counts[1].n == 0


def test_results_file(spark, tmp_path):
    out = rules.with_verdicts(rules.with_checks(items(spark, GOLDEN)))
    row = rules.result_rows(out).where("filename = 'abv_prohibited_fail.png'").first()
    assert list(row.asDict()) == list(rules.RESULT_COLUMNS) and "ALCOHOL_ABV_PROHIBITED: 5% ABV" in row.observed_values and "\n" not in row.evidence_text
    sinks.write_results(out, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').count() == len(GOLDEN)
    rows = rules.comparison_rows(out, {"brand_name": "FORM_BRAND_MATCHES_LABEL", "fanciful_name": "FORM_FANCIFUL_NAME_MATCHES_LABEL"}).where("item_id = 'clean_malt_pass'").orderBy("ord").collect()
    assert [(r.field, r.application_value, r.verdict) for r in rows] == [("brand_name", "OLD RIVER BREWING", "pass"), ("fanciful_name", "Not provided", "pass")]


@pytest.mark.parametrize(
    ("label", "alcohol", "contents"),
    [
        ("12%ALC", [12.0], []), ("12% ALC", [], []), ("40%", [], []), ("45.2 % alc/vol 90 proof", [45.0, 45.2], []), ("12.345% abv", [], []), ("0% abv 101% abv", [], []),
        ("750 mL and 1.5 L", [], [750.0, 1500.0]), ("16 FL. OZ.", [], [473.176]), ("12 FL.OZ", [], []), ("1 Pint", [], [473.176]), (None, [], []), ("", [], []),
    ],
)
def test_extraction(spark, label, alcohol, contents):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(label,)], "t string").select(ev.alcohol_values(F.col("t")).alias("a"), F.transform(ev.contents_values(F.col("t")), lambda x: F.round(x["ml"], 3)).alias("c")).first()
    assert row.a == alcohol and row.c == contents


def test_text_functions(spark):
    from pyspark.sql import functions as F

    def one(column, value, kind="string"):
        return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("v")).first().v

    assert one(text.unquoted, "'25337001000464'") == "25337001000464" and one(text.unquoted, "O'Neil") == "O'Neil"
    assert one(text.label_text, "  Old-River, 12! ") == "old river 12" and one(lambda c: text.label_text(text.decomposed(c)), "CORAZÓN") == "corazo n"
    assert one(text.product_family, "GINGER ALE") == "distilled_spirits" and one(text.product_family, "SWINE") == "wine" and one(text.product_family, "IPA") == "other"
    assert [one(text.trimmed_number, x) for x in ("750.0", "12.50", "100", "")] == ["750", "12.5", "100", ""]
    assert one(text.panel_files, "a|b; c| ") == ["a", "b; c"] and one(text.panel_files, None) == []
    assert [one(text.parsed_bool, x) for x in (" YES", "n", "", "maybe")] == [True, False, False, None]
    assert [one(text.duration_text, x, "double") for x in (0.25, 5.0, 61.5)] == ["250 ms", "5.00 s", "1m 1.5s"]
    assert one(text.used_on_label, "X LLC\nBRAND CO (Used on label)") == "BRAND CO" and one(text.used_on_label, "\n First \nSecond") == "First"
    assert one(lambda c: text.word_windows(c, 3, 1), "a b c d e f") == ["a b c", "c d e", "e f"] and one(lambda c: text.word_windows(c, 3, 1), " ") == []
    assert one(text.compact, "x" * 300) == "x" * 239 + "..." and one(text.safe_name, " a b/c?.png_") == "a_b_c_.png"
    assert one(text.registry_date, "02/30/2024") is None and str(one(text.registry_date, "02/28/2024")) == "2024-02-28"
    assert one(ev.heading_share, "GOVERNMENT WARNING: x") == 19 / 21 and one(ev.heading_share, "") == 1.0
    assert one(similarity.heading_score, "the government - warning") == 1.0 and one(similarity.heading_score, "nothing") < 0.6
    assert one(lambda c: F.array_join(ev.health_terms(c), ","), "Detox and SAFER") == "detox,safer"


def test_partial_ratio():
    assert similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.partial_ratio("", "a") == 0
    assert similarity.common_subsequence("kitten", "sitting") == 4 and similarity.partial_ratio("abcd", "xabxcdx") == 75


def test_unicode_white_space_and_accents(spark):
    from attestra.functions import evidence as ev
    from attestra.functions import text as tx

    rows = [("\tyes\u00a0", "CORAZ\u00d3N \uff21\uff22 x\u00b2"), ("\u2003NO", "caf\u00e9 nai\u0308ve"), (None, None), ("\x1f", "plain")]
    df = spark.createDataFrame(rows, "flag string, name string")
    got = df.select(tx.parsed_bool(F.col("flag")).alias("flag"), tx.label_text(F.col("name")).alias("name")).collect()
    assert [(r.flag, r.name) for r in got] == [(True, "corazo n ab x2"), (False, "cafe nai ve"), (False, ""), (False, "plain")]
    warned = spark.createDataFrame([("front\u00a0" + ev.WARNING.replace(" ", "\u00a0 "),)], "body string")
    assert warned.select(ev.warning_block(F.col("body"))).first()[0] == ev.WARNING


def test_judged_equals_checks(spark):
    from attestra.operators import rules

    fields = ", ".join(f"{f} {'boolean' if f == 'imported' else 'string'}" for f in rules.APPLICATION)
    texts = ["ACME 5% ALC/VOL 750 mL GOVERNMENT WARNING: (1) x", "", "ACME 5.5 ABV Government Warning: y PRODUCT OF FRANCE"]
    rows = [("ACME", "", "Ale", a, "750 mL", "", c, imp, "malt_beverage", t, conf) for a in ("5%", "", "strong") for c, imp in (("France", True), ("", True), ("Italy", False)) for t in texts for conf in (0.5, 0.9)]
    items = spark.createDataFrame(rows, f"{fields}, full_text string, avg_confidence double")
    for flags in ({}, {"review_unknown_warning": True, "review_before_rejection": True, "review_before_acceptance": True}):
        left, right = rules.judged(items, **flags), rules.with_verdicts(rules.with_checks(items), **flags).drop("checks")
        assert left.columns == right.columns and left.exceptAll(right).count() == right.exceptAll(left).count() == 0


def test_required_warning_is_left_out_of_scans(spark):
    w = ev.WARNING
    rows = [(0, f"5% abv {w}"), (1, w.replace(" ", "\n ")), (2, f"5%{w}"), (3, f"5% {w[:-1]} 7% vol"), (4, f"x {w} 1 L"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "id int, full_text string")
    got = {r.id: (r._front, r._block) for r in rules.with_parts(df).collect()}
    assert got[0] == ("5% abv ", w) and got[1] == ("", w) and got[2] == (f"5%{w}", w) and got[3][0] == rows[3][1] and got[4] == (f"x {w} 1 L", f"{w} 1 L") and got[5] == got[6] == ("", None)


def test_phrase_score_is_the_token_score(spark):
    pairs = [(a, b) for a in ("", "old mill", "mill old mill", "drive a car", "ld mil", "France") for b in ("", "the old mill of france", "old x mill", "CAR, drive!", f"x {ev.WARNING}")]
    df = spark.createDataFrame(pairs, "a string, b string")
    plain = lambda c: text.label_text(F.col(c))
    both = df.select(ev.token_score(F.col("a"), F.col("b")).alias("x"), ev.phrase_score(plain("a"), F.concat(F.lit(" "), plain("b"), F.lit(" "))).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both]


def test_compared_equals_comparison_rows(spark):
    fields = ", ".join(f"{f} {'boolean' if f == 'imported' else 'string'}" for f in rules.APPLICATION)
    rows = [("ACME", f, "Ale", a, "750 mL", "", c, True, "wine", t, conf) for f in ("", " Old\tMill ") for a in ("5%", "", "no") for c in ("France", "") for t in ("ACME 5% vol OLD MILL 1 L", "") for conf in (0.5, 0.9)]
    items = spark.createDataFrame(rows, f"{fields}, full_text string, avg_confidence double").withColumn("item_id", F.monotonically_increasing_id())
    asked = {"brand_name": "FORM_BRAND_MATCHES_LABEL", "fanciful_name": "FORM_FANCIFUL_NAME_MATCHES_LABEL", "alcohol_content": "FORM_ALCOHOL_CONTENT_MATCHES_LABEL", "country_of_origin": "COUNTRY_OF_ORIGIN_MATCH"}
    left, right = rules.compared(items, asked), rules.comparison_rows(rules.with_verdicts(rules.with_checks(items)), asked)
    assert left.columns == right.columns and left.exceptAll(right).count() == right.exceptAll(left).count() == 0


#: Texts with several headings, white space of other kinds, broken numbers, units next to each other and signs of all kinds.
ODD = [
    "", " ", "a  b", f"x {ev.WARNING}", f"x {ev.WARNING.replace(': (1)', ':  (1)')}  ", f"x{ev.WARNING}", f"x {ev.WARNING}\n", f"x {ev.WARNING.replace(': (1)', ':(1)')}", f"{ev.WARNING}", f"{ev.WARNING} {ev.WARNING}",
    f"government warning: {ev.WARNING}", f"GOVERNMENT WARNING: x {ev.WARNING}", f"government {ev.WARNING}", f"Government warnıng : {ev.WARNING}", "GOVERNMENT WARNING:", "GOVERNMENT  WARNING :\ty z", f"GOVERNMENT WARNING: {ev.WARNING[20:]}",
    "12.345% abv 1234% 45.2%alc/vol 45.2 % % vol 101% 7.5 % ABV. 90 proof 13.% by vol 0.00% 45.25 alcohol  by volume", "5%x 5 %, 5.5.5% a5% 5_% _5% 5%", "750mL 1.5 L 1.l 12.5.ml 1 fl.\toz 2 fl  oz. 16 FL. OZ 3 pt. 4 qt 5 gal. 6 fluid\nounces 7 l/8 L9", "٣ ml 1٣ ml x1 ml _1 ml 1 mlé",
    "".join(map(chr, range(1, 128))), "café ＡＢ  x² naïve -- END", "　wide　", "\tx\x1f", " a", "b ", "é c", "c é",
]


def test_shortcuts_give_what_patterns_give(spark):
    c = F.col("full_text")
    old = {
        "heading": ev.warning_heading(c), "block": ev.warning_block(c), "plain": F.lower(F.trim(F.regexp_replace(text.folded(c), r"\P{Alnum}+", " "))), "bare": F.btrim(c, F.lit(text.WHITE)),
        "percent": F.sort_array(F.array_distinct(F.filter(F.transform(F.concat(F.regexp_extract_all(c, F.lit(ev.PERCENT), F.lit(1)), F.regexp_extract_all(c, F.lit(ev.BARE_PERCENT), F.lit(1))), lambda x: F.round(x.cast("double"), 2)), lambda x: (x > 0) & (x <= 100)))),
        "amounts": F.regexp_extract_all(c, F.lit(ev.CONTENTS), F.lit(0)),
    }
    unit = lambda m: text.collapsed(F.lower(F.regexp_extract(m, ev.CONTENTS, 2)))
    old["ml"] = F.filter(F.transform("amounts", lambda m: F.regexp_extract(m, ev.CONTENTS, 1).cast("double") * F.try_element_at(ev._unit_map(), unit(m))), lambda x: x.isNotNull())
    new = {
        "heading": F.col("_heading"), "block": F.col("_block"), "plain": text.label_text(c), "bare": text.strip(c), "percent": ev.alcohol_values(F.replace(c, F.lit("proof"), F.lit(""))), "amounts": F.regexp_extract_all(c, F.lit(ev._CONTENTS), F.lit(0)),
        "ml": ev.contents_values(c)["ml"],
    }
    df = rules.with_parts(spark.createDataFrame([(t,) for t in ODD], "full_text string"))
    for name, way in new.items():
        got = df.withColumn("amounts", old["amounts"]).select("full_text", old[name].alias("a"), way.alias("b")).collect()
        assert [(r.full_text, r.b) for r in got] == [(r.full_text, r.a) for r in got], name
    cut = {r.full_text for r in df.where("_cut").collect()}
    assert cut == {ODD[i] for i in (3, 4, 6, 8, 12, 16)}


def test_known_names_score_as_texts(spark):
    names = ["USA", "U.S.A.", "United States of America", "drive"]
    df = spark.createDataFrame([(t, w) for t in (" ", " of the united u s x ", " usa ", " states united ", " america ") for w in (True, False)], "p string, w boolean")
    for n in names:
        two = df.select(ev.known_score(n, F.col("p"), F.col("w")).alias("x"), ev.phrase_score(text.label_text(F.lit(n)), F.col("p"), F.col("w")).alias("y"), ev.token_score(F.lit(n), F.concat("p", F.when(F.col("w"), ev.WARNING).otherwise(""))).alias("z")).collect()
        assert [r.x for r in two] == [r.y for r in two] == [r.z for r in two], n


def _items(spark):
    fields = ", ".join(f"{f} {'boolean' if f == 'imported' else 'string'}" for f in rules.APPLICATION)
    rows = [("ACME", f, "Ale", a, "750 mL", "", c, i, "wine", t, conf) for f in ("", "\tOld Mill ", "Not provided") for a in ("5%", "", "no") for c, i in (("France", True), (None, True), ("United States", False)) for t in ("ACME 5% vol OLD MILL 1 L", "") for conf in (0.5, 0.9)]
    return spark.createDataFrame(rows, f"{fields}, full_text string, avg_confidence double").withColumn("item_id", F.monotonically_increasing_id())


def test_reasons_are_made_where_they_are_shown(spark):
    # Messages of thirteen rules were once columns of every item, of which one is shown.
    judged = rules.judged(_items(spark)).select("item_id", "top_reason")
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    carried = [m for m in ("Brand name appears to match the application field.", "No malt 16 fl. oz. net-contents issue detected.") if m in plan]
    assert not carried
    whole = rules.with_verdicts(rules.with_checks(_items(spark))).select("item_id", "top_reason")
    assert judged.exceptAll(whole).count() == whole.exceptAll(judged).count() == 0


def test_alike_items_are_counted_before_they_become_rows(spark):
    asked = {"brand_name": "FORM_BRAND_MATCHES_LABEL", "fanciful_name": "FORM_FANCIFUL_NAME_MATCHES_LABEL", "alcohol_content": "FORM_ALCOHOL_CONTENT_MATCHES_LABEL", "country_of_origin": "COUNTRY_OF_ORIGIN_MATCH"}
    items = _items(spark)
    got = rules.compared_counts(items, asked)
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert any("Aggregate" in line for line in lines[at:])
    blank = {(r.item_id, f) for r in items.collect() for f in asked if not (r[f] or "").strip()}
    rows = rules.compared(items, asked).collect()
    want = {}
    for r in rows:
        n, b = want.get((r.ord, r.field, r.verdict), (0, 0))
        want[r.ord, r.field, r.verdict] = (n + 1, b + ((r.item_id, r.field) in blank))
    assert {(r.ord, r.field, r.verdict): (r.n, r.blank) for r in got.collect()} == want
