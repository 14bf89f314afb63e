"""Where a label's warning stands, and what a font's name says of its weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import file_stem, text

# Words of font names by weight, tried in this order.
NOT_QUITE_BOLD = r"semi-?bold|demi-?bold|medium"
VERY_BOLD = r"extra-?bold|ultra-?bold|black|heavy"
BOLD = r"(^|[-_])bold($|[-_.])"
LIGHT = r"extra-?light|thin|light|regular|book"


def weight_label(name: Column) -> Column:
    """``bold``, ``not_bold``, or null where a font's name does not say."""
    low = F.regexp_replace(F.lower(text(name)), " ", "-")
    return F.when(low.rlike(NOT_QUITE_BOLD), "not_bold").when(low.rlike(VERY_BOLD), "bold").when(low.rlike(BOLD), "bold").when(low.rlike(LIGHT), "not_bold")


def font_decision(weight: Column, quality: Column) -> Column:
    return F.when(quality == "degraded", "needs_review_unclear").when(weight == "bold", "clearly_bold").otherwise("clearly_not_bold")


def header_decision(label: Column, quality: Column) -> Column:
    return F.when(quality == "degraded", "needs_review_unclear").otherwise(label)


def family(path: Column) -> Column:
    """Folder and stem without words of weight."""
    stem = F.lower(file_stem(path))
    bare = F.regexp_replace(F.regexp_replace(stem, r"(extra|ultra|semi|demi)[-_ ]?bold", ""), r"bold|black|heavy|medium|regular|book|thin|light|italic|oblique", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[-_ ]+", "-"), "^-+|-+$", "")
    return F.concat(F.lower(text(F.try_element_at(F.split(path, "/"), F.lit(-2)))), F.lit(":"), F.when(bare == "", stem).otherwise(bare))


def warning_blocks(blocks: Column) -> Column:
    """Blocks with one of the heading's words among their letters."""
    letters = lambda b: F.regexp_replace(F.upper(text(b["text"])), r"[^\p{L}]", "")
    return F.filter(blocks, lambda b: letters(b).contains("GOVERNMENT") | letters(b).contains("WARNING"))


def crop_bounds(blocks: Column, width: Column, height: Column) -> Column:
    """Pixels round the warning's blocks, padded by shares of their height; null without a box.

    Coordinates over 1.5 are pixels, others shares of the image.
    """
    boxes = F.filter(F.transform(warning_blocks(blocks), lambda b: b["bbox"]), lambda b: F.coalesce(F.size(b) > 0, F.lit(False)))

    def shares(box: Column) -> Column:
        most = F.array_max(F.transform(F.flatten(box), lambda v: F.abs(v)))
        by_x, by_y = (F.when(most > 1.5, F.greatest(side, F.lit(1))).otherwise(1) for side in (width, height))
        x, y = F.transform(box, lambda p: p[0] / by_x), F.transform(box, lambda p: p[1] / by_y)
        return F.struct(F.greatest(F.lit(0.0), F.array_min(x)).alias("x0"), F.greatest(F.lit(0.0), F.array_min(y)).alias("y0"), F.least(F.lit(1.0), F.array_max(x)).alias("x1"), F.least(F.lit(1.0), F.array_max(y)).alias("y1"))

    found = F.transform(boxes, shares)
    edge = lambda f, side: f(F.transform(found, lambda b: b[side]))
    x0, y0, x1, y1 = edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1")
    tall = F.greatest((y1 - y0) * height, F.lit(1.0))
    pad_x, pad_y = F.greatest(F.lit(8), F.bround(tall * 0.8).cast("int")), F.greatest(F.lit(6), F.bround(tall * 0.6).cast("int"))
    at = lambda v, side: F.bround(v * side).cast("int")
    return F.when(F.size(found) > 0, F.struct(
        F.greatest(F.lit(0), at(x0, width) - pad_x).alias("left"), F.greatest(F.lit(0), at(y0, height) - pad_y).alias("top"),
        F.least(width, at(x1, width) + pad_x).alias("right"), F.least(height, at(y1, height) + pad_y).alias("bottom")))
