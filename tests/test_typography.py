from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import typography


def test_fonts(spark):
    rows = [("Arial-Bold.ttf", "bold"), ("x-SemiBold", "not_bold"), ("Demi Bold", "not_bold"), ("Medium-Bold", "not_bold"), ("ExtraBold", "bold"), ("Boldness", None), ("Light", "not_bold"), ("Plain", None), (None, None)]
    df = spark.createDataFrame(rows, "n string, w string")
    assert all(r.w == r.v for r in df.select("w", typography.weight_label(F.col("n")).alias("v")).collect())
    one = spark.createDataFrame([("f/Arial/Arial-SemiBold_Italic.ttf", "ok"), ("f/X/Bold.otf", "degraded")], "p string, q string")
    got = one.select(typography.family(F.col("p")).alias("f"), typography.font_decision(F.lit("bold"), F.col("q")).alias("d"), typography.header_decision(F.lit("h"), F.col("q")).alias("h")).collect()
    assert [tuple(r) for r in got] == [("arial:arial", "clearly_bold", "h"), ("x:bold", "needs_review_unclear", "needs_review_unclear")]


def test_warning_crop(spark):
    blocks = [("Government", [[0.1, 0.5], [0.4, 0.6]]), ("WARN-ING:", [[300.0, 250.0], [500.0, 300.0]]), ("other", [[0.0, 0.0], [1.0, 1.0]]), ("warning", None)]
    df = spark.createDataFrame([(blocks, 1000, 500), ([("x", None)], 10, 10)], "b array<struct<text:string,bbox:array<array<double>>>>, w int, h int")
    got = [r.c for r in df.select(typography.crop_bounds(F.col("b"), F.col("w"), F.col("h")).alias("c")).collect()]
    assert tuple(got[0]) == (60, 220, 540, 330) and got[1] is None
