"""The chain from records and panels to verdicts."""

from __future__ import annotations

from attestra.operators import chain

FORM = "struct<brand_name:string,fanciful_name:string,class_type_description:string,alcohol_content:string,net_contents:string,source_of_product:string,status:string,applicant_name_address:string>"
APPLICATION = "struct<brand_name:string,fanciful_name:string,class_type:string,alcohol_content:string,net_contents:string,imported:boolean>"


def tables(spark):
    parsed = spark.createDataFrame([
        ("1", ("Form Brand", None, "WHISKY", "45", "750 mL", "Imported", "approved", "\nACME CO\nOLD MILL (Used on label)"), ("Old River", "", None, None, "", None)),
        ("2", ("x", None, None, None, None, None, None, None), (None, None, None, None, None, False)), ("3", (None,) * 8, (None,) * 6), ("4", ("y",) + (None,) * 7, (None,) * 6),
    ], f"ttb_id string, form_fields {FORM}, application {APPLICATION}")
    registry = spark.createDataFrame([("'1'", "FRANCE"), ("1", "ITALY"), ("9", "SPAIN")], "ttb_id string, origin_desc string")
    panels = spark.createDataFrame([
        ("'1'", 1, "a.png", "Front", "p", 200), ("1", 2, "b.png", "Back", "p", 200), ("1", 3, "c.png", "Neck", "", 200), ("2", 1, "d.png", None, "p", 200), ("2", 2, "e.png", None, "p", 0), ("3", 1, "f.png", "F", "p", 200), ("4", 1, "g.png", "F", "p", 404),
    ], "ttb_id string, panel_order int, filename string, image_type string, raw_image_path string, http_status int")
    ocr = spark.createDataFrame([("1", 1, "Product of FRANCE 750 ml", 10, True), ("1", 2, "OLD RIVER whisky 45% alc/vol", 30, None), ("1", 3, "Old River", 5, True), ("2", 1, None, None, None), ("4", 1, "y", 1, True)], "ttb_id string, panel_order int, full_text string, total_ms long, cache_hit boolean")
    return parsed, registry, panels, ocr


def test_chain(spark):
    parsed, registry, attachments, ocr = tables(spark)
    wanted, panels = chain.expected(parsed, registry), chain.read_panels(attachments, ocr)
    fields = chain.field_results(wanted, panels)
    got = {(r.ttb_id, r.field_name): r for r in fields.collect()}
    assert len(got) == 14 and {i for i, _ in got} == {"1", "2"}
    brand, origin, maker = got["1", "brand_name"], got["1", "country_of_origin"], got["1", "applicant_or_producer"]
    assert (brand.expected, brand.verdict, brand.outcome, brand.score, brand.best_panel_order, brand.best_panel_type, brand.best_panel_filename) == ("Old River", "pass", "matched", 100.0, 2, "Back", "b.png")
    assert (origin.expected, origin.verdict, origin.best_panel_order) == ("FRANCE", "pass", 1) and (maker.expected, maker.outcome, maker.score) == ("OLD MILL", "not_found", 50.0)
    assert (got["1", "alcohol_content"].verdict, got["1", "net_contents"].best_panel_order, got["1", "fanciful_name"].verdict) == ("pass", 1, "not_applicable")
    assert got["1", "fanciful_name"].reviewer_action == chain.NO_VALUE and brand.evidence_text.startswith("OLD RIVER")
    lone = got["2", "brand_name"]
    assert (lone.verdict, lone.outcome, lone.score, lone.best_panel_order, lone.evidence_text) == ("needs_review", "not_found", 0.0, None, "")
    done = {r.ttb_id: r for r in chain.application_results(wanted, panels, fields).collect()}
    assert set(done) == {"1", "2"}
    one = done["1"]
    assert (one.image_count, one.ocr_image_count, one.cache_hit_count, one.total_ocr_ms, one.overall_verdict, one.status) == (2, 2, 1, 40, "needs_review", "approved")
    total = chain.summary(chain.application_results(wanted, panels, fields)).first()
    assert (total.application_count, total.pass_count, total.needs_review_count, total.image_count, total.mean_per_application, total.max_per_application) == (2, 0, 2, 3, 20.0, 40)
    of = {r.field_name: r for r in chain.field_summary(fields).collect()}
    assert (of["brand_name"].attempted, of["brand_name"].matched, of["brand_name"].match_rate, of["brand_name"].mean_score) == (2, 1, 0.5, 50.0)
    assert (of["fanciful_name"].attempted, of["fanciful_name"].match_rate, of["fanciful_name"].mean_score) == (0, None, None)


def test_chain_of_nothing(spark):
    parsed, registry, attachments, ocr = tables(spark)
    wanted, panels = chain.expected(parsed.limit(0), registry.limit(0)), chain.read_panels(attachments.limit(0), ocr.limit(0))
    fields = chain.field_results(wanted, panels)
    assert fields.count() == 0 and chain.application_results(wanted, panels, fields).count() == 0
    total = chain.summary(chain.application_results(wanted, panels, fields)).first()
    assert (total.application_count, total.image_count, total.mean_per_application, total.max_per_application) == (0, 0, None, None)
