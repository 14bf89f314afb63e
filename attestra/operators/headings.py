"""The block, or run of neighbouring blocks, of an image that reads most like the warning's heading.

Blocks are an array of (text, confidence, bbox) in reading order. All of it is
column expressions over that array: no image needs a shuffle or Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, strip, text

# The heading's letters, how many letters of a text are looked at, the widest run and the least score.
HEADING = "GOVERNMENTWARNING"
WORDS = ["GOVERNMENT", "WARNING"]
LETTERS, WIDEST, LEAST = 25, 7, 0.72


def letters(c: Column) -> Column:
    return F.regexp_replace(F.upper(text(c)), r"[^\p{L}]", "")


def common_share(c: Column, target: str) -> Column:
    """Length of the longest common subsequence with ``target`` over the length of ``target``, 63 letters at most.

    One word of bits holds a row of the usual table: each letter of the text is a
    few operations on it.
    """
    full = (1 << len(target)) - 1
    masks = F.create_map(*[F.lit(x) for ch in dict.fromkeys(target) for x in (ch, sum(1 << i for i, t in enumerate(target) if t == ch))])

    def step(state: Column, ch: Column) -> Column:
        hit = state.bitwiseAND(F.coalesce(F.try_element_at(masks, ch).cast("bigint"), F.lit(0).cast("bigint")))
        return (state + hit).bitwiseOR(state - hit).bitwiseAND(F.lit(full).cast("bigint"))

    left = F.aggregate(F.split(c, ""), F.lit(full).cast("bigint"), step)
    return F.when(F.length(c) > 0, (len(target) - F.bit_count(left)) / float(len(target))).otherwise(0.0)


def heading_score(plain: Column) -> Column:
    """From :func:`letters`: 1 with the heading whole, 0.95 with both of its words, else the share of it that its first letters hold in order."""
    both = plain.contains(WORDS[0]) & plain.contains(WORDS[1])
    return F.when(plain.contains(HEADING), 1.0).when(both, 0.95).otherwise(common_share(F.substring(plain, 1, LETTERS), HEADING))


def points(box: Column) -> Column:
    """The points of a box that have two numbers."""
    return F.filter(box, lambda p: F.coalesce((F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False)))


def union_box(boxes: Column) -> Column:
    """The rectangle round all points of some boxes, corner by corner; null where a box or every point is missing."""
    every = F.flatten(F.transform(boxes, points))
    x, y = F.transform(every, lambda p: p[0]), F.transform(every, lambda p: p[1])
    corners = [(f(x), g(y)) for f, g in ((F.array_min, F.array_min), (F.array_max, F.array_min), (F.array_max, F.array_max), (F.array_min, F.array_max))]
    return F.when(F.forall(boxes, lambda b: b.isNotNull()) & (F.size(every) > 0), F.array(*[F.array(a, b) for a, b in corners]))


def bounds(box: Column, width: Column, height: Column) -> Column:
    """Least and greatest x and y as shares of the image, cut to it; the whole image without points. Values over 1.5 are pixels."""
    p = points(box)
    most = F.array_max(F.transform(F.flatten(p), lambda v: F.abs(v)))
    by = {a: F.when(most > 1.5, F.greatest(side.cast("double"), F.lit(1.0))).otherwise(1.0) for a, side in (("x", width), ("y", height))}
    x, y = F.transform(p, lambda q: q[0] / by["x"]), F.transform(p, lambda q: q[1] / by["y"])
    inside = F.struct(F.greatest(F.lit(0.0), F.array_min(x)).alias("x0"), F.greatest(F.lit(0.0), F.array_min(y)).alias("y0"), F.least(F.lit(1.0), F.array_max(x)).alias("x1"), F.least(F.lit(1.0), F.array_max(y)).alias("y1"))
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    return F.when(F.coalesce(F.size(p) > 0, F.lit(False)), inside).otherwise(whole)


def best_heading(blocks: Column, least: float = LEAST, widest: int = WIDEST) -> Column:
    """(text, score, confidence, bbox, first, width) of the best block or run of up to ``widest`` blocks; null if none scores ``least``.

    The highest score counts, then the higher mean confidence of those known, then
    single blocks before runs, earlier before later, shorter before longer. A run with
    a block that has no box, or with no point at all, is none.
    """
    return bound(blocks, lambda b: bound(_read(b), lambda read: _best(b, read, least, widest)))


def _read(blocks: Column) -> Column:
    """What a run asks of its blocks: letters, confidence, whether there is a box, and a point in it."""
    return F.transform(blocks, lambda b: F.struct(letters(b["text"]).alias("plain"), b["confidence"].cast("double").alias("sure"), b["bbox"].isNotNull().alias("boxed"), F.coalesce(F.size(points(b["bbox"])) > 0, F.lit(False)).alias("placed")))


def _best(blocks: Column, read: Column, least: float, widest: int) -> Column:
    n = F.size(blocks)

    def run(start: Column, width: Column) -> Column:
        return bound(F.slice(read, start + 1, width), lambda part: of_part(part, start, width))

    def of_part(part: Column, start: Column, width: Column) -> Column:
        known = F.filter(F.transform(part, lambda b: b["sure"]), lambda v: v.isNotNull())
        sure = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))
        usable = F.forall(part, lambda b: b["boxed"]) & F.exists(part, lambda b: b["placed"])
        score = F.when(usable, bound(F.array_join(F.transform(part, lambda b: b["plain"]), ""), heading_score))
        turn = F.when(width == 1, start).otherwise(n + start * (widest + 1) + width)
        return F.struct(score.alias("score"), F.coalesce(sure, F.lit(0.0)).alias("rank"), (-turn).alias("turn"), start.alias("first"), width.alias("width"), sure.alias("confidence"))

    starts = F.sequence(F.lit(0), n - 1)
    runs = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(widest), n - s)), lambda w: run(s, w))))
    best = F.array_max(F.filter(runs, lambda r: r["score"] >= least))
    return F.when(n > 0, F.transform(F.array(best), lambda b: F.when(b.isNotNull(), F.struct(
        strip(F.array_join(F.transform(F.slice(blocks, b["first"] + 1, b["width"]), lambda x: text(x["text"])), " ")).alias("text"), b["score"].alias("score"), b["confidence"].alias("confidence"),
        union_box(F.transform(F.slice(blocks, b["first"] + 1, b["width"]), lambda x: x["bbox"])).alias("bbox"), b["first"].alias("first"), b["width"].alias("width"))))[0])


def crop(box: Column, line: Column, share: Column, width: Column, height: Column, x: float = 0.30, top: float = 0.20, bottom: float = 0.05, factor: float = 1.08) -> Column:
    """Pixels (left, top, right, bottom) round the part of a line's box that the heading takes; ``share`` is what :func:`evidence.heading_share` says of ``line``."""
    b, w, h = bounds(box, width, height), width.cast("double"), height.cast("double")
    left, up, right, down = b["x0"] * w, b["y0"] * h, b["x1"] * w, b["y1"] * h
    wide, tall = F.greatest(right - left, F.lit(1.0)), F.greatest(down - up, F.lit(1.0))
    right = F.when(share < 0.98, left + wide * F.least(F.lit(1.0), share * factor)).otherwise(right)
    pad_x, pad_top, pad_bottom = F.greatest(F.lit(3.0), tall * x), F.greatest(F.lit(2.0), tall * top), F.greatest(F.lit(1.0), tall * bottom)
    left, up = F.least(F.greatest(left, F.lit(0.0)), w - 1), F.least(F.greatest(up, F.lit(0.0)), h - 1)
    right, down = F.least(F.greatest(right, left + 1), w), F.least(F.greatest(down, up + 1), h)
    at = lambda v: F.bround(v).cast("int")
    return F.struct(
        F.greatest(F.lit(0), at(left - pad_x)).alias("left"), F.greatest(F.lit(0), at(up - pad_top)).alias("top"), F.least(width.cast("int"), at(right + pad_x)).alias("right"), F.least(height.cast("int"), at(down + pad_bottom)).alias("bottom")
    )
