"""Values that a label's text gives evidence of."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE_CLASS, bound, collapsed, label_text, strip, text

# Patterns, units and lists that decide verdicts.
ABV = r"(?i)\b\d+(?:\.\d+)?\s*%?\s*(?:A\.?B\.?V\.?|ABV)\b"
PERCENT = r"(?i)\b(\d{1,3}(?:\.\d{1,2})?)\s*%?\s*(?:alc\.?\s*/?\s*vol\.?|alcohol\s+by\s+volume|by\s+vol\.?|a\.?b\.?v\.?|abv)\b"
BARE_PERCENT = r"\b(\d{1,3}(?:\.\d{1,2})?)\s*%\b"
PROOF = r"(?i)\b(\d{2,3}(?:\.\d+)?)\s*proof\b"
SIXTEEN_OUNCES = r"(?i)\b16\s*(?:fl\.?\s*)?(?:oz\.?|ounces?)\b"
ONE_PINT = r"(?i)\b1\s*pint\b"
CONTENTS = r"(?i)\b(\d+(?:\.\d+)?)\s*(ml|milliliters?|millilitres?|l|liters?|litres?|fl\.?\s*oz\.?|fluid\s+ounces?|pints?|pt\.?|quarts?|qt\.?|gallons?|gal\.?)\b"
UNIT_ML = {
    1.0: ["ml", "milliliter", "milliliters", "millilitre", "millilitres"],
    1000.0: ["l", "liter", "liters", "litre", "litres"],
    29.5735295625: ["fl oz", "fl. oz", "fl. oz.", "fluid ounce", "fluid ounces", "oz", "oz."],
    473.176473: ["pint", "pints", "pt", "pt."],
    946.352946: ["quart", "quarts", "qt", "qt."],
    3785.411784: ["gallon", "gallons", "gal", "gal."],
}
WARNING = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. "
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems."
)
#: The same in its :func:`label_text` form, by words, a blank round each.
WARNING_WORDS = [f" {w} " for w in dict.fromkeys(re.sub("[^a-z0-9]+", " ", WARNING.lower()).split())]
COUNTRIES = ["Argentina", "Australia", "Austria", "Brazil", "Canada", "Chile", "England", "France", "Germany", "Greece", "Ireland", "Italy", "Japan", "Mexico", "New Zealand", "Portugal", "Scotland", "South Africa", "Spain", "United States"]
ALIASES = {"United States": ["USA", "U.S.A.", "United States of America"]}
HEALTH_TERMS = ["detox", "healthy", "safer", "less toxic", "protective"]


_NUMBER = r"\b(\d{1,3}(?:\.\d{1,2})?)\s*"
#: :data:`PERCENT` or :data:`BARE_PERCENT`. No part of a number or a blank can be what comes next, so none is given back.
_ANY_PERCENT = rf"(?i)\b(\d{{1,3}}+(?:\.\d{{1,2}}+)?+)\s*+(?:{PERCENT.removeprefix('(?i)' + _NUMBER).replace('%?', '%?+', 1).replace(chr(92) + 's*', chr(92) + 's*+', 1)}|{BARE_PERCENT.removeprefix(_NUMBER)})"
#: :data:`CONTENTS`, which only a digit can begin, likewise.
_CONTENTS = CONTENTS.replace(r"\b(\d+(?:\.\d+)?)\s*", r"(?=[0-9])\b(\d++(?:\.\d++)?+)\s*+", 1)
#: The heading in any case, dotted and dotless i among them, with white space of Unicode.
_HEADING = f"government[{WHITE_CLASS}]+warn[i\u0130\u0131]ng[{WHITE_CLASS}]*:"


def _says(c: Column, part: str) -> Column:
    """Whether a text has a part in lower-case ASCII, whatever its case there: what a pattern needs is looked for before its scan."""
    return F.contains(F.lower(text(c)), F.lit(part))


def abv_shorthand(c: Column) -> Column:
    """The first number followed by ABV, null where there is none."""
    some = _says(c, "abv") | _says(c, "a.b") | _says(c, "ab.")
    return F.when(some, F.nullif(F.regexp_extract(text(c), ABV, 0), F.lit("")))


def alcohol_values(c: Column) -> Column:
    """Sorted distinct percentages over 0 up to 100; proof is halved."""
    # Both kinds of percentages begin with the same number and end behind no other one, so one scan finds what two find.
    # They have two decimals at most, so nothing is left to round.
    percent = F.filter(F.regexp_extract_all(text(c), F.lit(_ANY_PERCENT), F.lit(1)).cast("array<double>"), lambda x: (x > 0) & (x <= 100))
    proof = F.filter(F.regexp_extract_all(text(c), F.lit(PROOF), F.lit(1)).cast("array<double>"), lambda x: (x > 0) & (x <= 200))
    return F.sort_array(F.array_distinct(F.when(_says(c, "proof"), F.concat(percent, F.transform(proof, lambda x: F.round(x / 2, 2)))).otherwise(percent)))


def _any_near(expected: Column, observed: Column, near: Callable[[Column, Column], Column]) -> Column:
    """Whether some of two lists of numbers are near; equal ones are, and are found without a test of all pairs."""
    pairs = F.exists(expected, lambda e: F.exists(observed, lambda o: near(e, o)))
    return F.when((F.size(expected) == 0) | (F.size(observed) == 0), False).when(F.arrays_overlap(expected, observed), True).otherwise(pairs)


def alcohol_match(expected: Column, observed: Column, tolerance: float = 0.05) -> Column:
    return _any_near(expected, observed, lambda e, o: F.abs(e - o) <= tolerance)


def bad_sixteen_ounces(c: Column) -> Column:
    return F.contains(text(c), F.lit("16")) & text(c).rlike(SIXTEEN_OUNCES) & ~text(c).rlike(ONE_PINT)


def _unit_map() -> Column:
    return F.create_map(*[F.lit(x) for ml, names in UNIT_ML.items() for name in names for x in (name, ml)])


def contents_values(c: Column) -> Column:
    """(ml, evidence) of each quantity whose unit is known, in the order of the text."""
    # One scan of the text; amount and unit are then read from the matches, which are short.
    def ml(m: Column) -> Column:
        amount = F.regexp_extract(m, r"^\d+(?:\.\d+)?", 0)
        unit = F.lower(F.substring(m, F.length(amount) + 1, F.length(m)))
        return amount.cast("double") * F.coalesce(F.try_element_at(_unit_map(), F.ltrim(unit)), F.try_element_at(_unit_map(), collapsed(unit)))

    found = F.transform(F.regexp_extract_all(text(c), F.lit(_CONTENTS), F.lit(0)), lambda m: F.struct(ml(m).alias("ml"), m.alias("evidence")))
    return F.filter(found, lambda x: x["ml"].isNotNull())


def contents_match(expected: Column, observed: Column) -> Column:
    """Within 2 ml or a hundredth of what is expected."""
    return _any_near(expected["ml"], observed["ml"], lambda e, o: F.abs(e - o) <= F.greatest(F.lit(2.0), e * 0.01))


def warning_tail(c: Column) -> Column:
    """From the warning's heading to the end of the text as it is; empty where there is none."""
    return F.regexp_extract(text(c), f"(?is){_HEADING}.*", 0)


_HEAD = WARNING.partition(" (")[0]
_REST = WARNING.removeprefix(_HEAD + " ")


def first_heading(c: Column, before: Column) -> Column:
    """:func:`warning_heading` of a text, ``before`` being what stands before the heading in its required form: the first one if nothing there begins like another."""
    return F.when((F.length(before) < F.length(c)) & ~_says(before, "government"), _HEAD).otherwise(warning_heading(c))


def block_behind(c: Column, before: Column, heading: Column) -> Column:
    """From the first heading to the end of the text, white space collapsed; null without one. The required warning with blanks alone at its joints needs no pattern."""
    plain, start = F.rtrim(c), F.length(before) + 1
    gap = F.substring(c, start + len(_HEAD), F.length(plain) - start + 1 - len(_HEAD) - len(_REST))
    tail = F.substring(c, start, F.length(c))
    exact = (heading == _HEAD) & F.endswith(plain, F.lit(_REST)) & (gap != "") & (F.trim(gap) == "")
    return F.when(heading.isNull(), F.lit(None)).when(exact, WARNING).otherwise(collapsed(tail))


def warning_block(c: Column) -> Column:
    """From the warning's heading to the end of the text, white space collapsed; null where there is none."""
    return F.nullif(collapsed(warning_tail(c)), F.lit(""))


def warning_heading(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text(c), f"(?i){_HEADING}", 0), F.lit(""))


def health_terms(c: Column) -> Column:
    return F.filter(F.array(*map(F.lit, HEALTH_TERMS)), lambda t: F.contains(F.lower(text(c)), t))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(label_text(c), " "), ""))


def token_score(expected: Column, observed: Column) -> Column:
    """Share of the expected distinct words that are observed, 0 to 100."""
    return word_score(tokens(expected), tokens(observed))


def word_score(want: Column, have: Column) -> Column:
    """The same from distinct words."""
    return F.when((F.size(want) == 0) | (F.size(have) == 0), 0.0).otherwise(100.0 * F.size(F.array_intersect(want, have)) / F.size(want))


def phrase_score(want: Column, padded: Column, warned: Column | None = None) -> Column:
    """:func:`token_score` of two texts in their :func:`label_text` form, the second with a blank at each end.

    A phrase that stands there as it is has all its words; only else is each looked for.
    ``warned`` says whether the required warning follows that text: its words count as well.
    """
    more = F.lit(False) if warned is None else warned
    whole = F.concat(F.lit(" "), want, F.lit(" "))
    each = F.array_distinct(F.split(F.concat(F.lit(" "), F.replace(want, F.lit(" "), F.lit(" | ")), F.lit(" ")), r"\|"))
    share = bound(each, lambda e: 100.0 * F.size(F.filter(e, lambda w: F.contains(padded, w) | (more & w.isin(WARNING_WORDS)))) / F.size(e))
    one = F.when(more & whole.isin(WARNING_WORDS), 100.0).otherwise(0.0)
    return F.when(want == "", 0.0).when(F.contains(padded, whole), 100.0).when(F.contains(want, F.lit(" ")), share).otherwise(one)


def words_score(want: Column, padded: Column, warned: Column) -> Column:
    """:func:`phrase_score` of a list of words."""
    stands = lambda w: F.contains(padded, w) | (warned & w.isin(WARNING_WORDS))
    return bound(F.array_distinct(want), lambda ws: F.when(F.size(ws) == 0, 0.0).otherwise(100.0 * F.size(F.filter(ws, lambda w: stands(F.concat(F.lit(" "), w, F.lit(" "))))) / F.size(ws)))


def known_score(want: str, padded: Column, warned: Column) -> Column:
    """:func:`phrase_score` of a text that is known beforehand, whatever its form."""
    words = [f" {w} " for w in dict.fromkeys(re.sub("[^a-z0-9]+", " ", want.lower()).split())]
    stands = [F.contains(padded, F.lit(w)) | warned if w in WARNING_WORDS else F.contains(padded, F.lit(w)) for w in words]
    return 100.0 * reduce(lambda a, b: a + b, [s.cast("int") for s in stands]) / len(words)


def country_score(expected: Column, c: Column, score=token_score, known: Callable[[str], Column] | None = None) -> Column:
    """The best score of a country's name and aliases; ``known`` scores a name that has aliases, and these, if ``score`` is not to."""
    best = F.when(strip(expected) == "", 0.0).otherwise(score(expected, c))
    for name, others in ALIASES.items():
        if known:
            best = F.when(expected == name, F.greatest(*map(known, [name, *others]))).otherwise(best)
        else:
            best = F.when((expected == name) & (best < 100), F.greatest(best, *[score(F.lit(o), c) for o in others])).otherwise(best)
    return best


def _by_first_letter(names: list[str]) -> str:
    """A pattern of any of the names that asks for their first letter once."""
    return "|".join(f"{a}(?:{'|'.join(n[1:] for n in names if n[0] == a)})" for a in dict.fromkeys(n[0] for n in names))


_COUNTRY = f" (?:{_by_first_letter([n.lower() for n in COUNTRIES])})(?= )"


def named_countries(padded: Column) -> Column:
    """The listed countries that a text names, a blank round each: all that :func:`conflicting_country` needs of the text."""
    return F.concat(F.array_join(F.regexp_extract_all(padded, F.lit(_COUNTRY), F.lit(0)), " "), F.lit(" "))


def conflicting_country(own: Column, have: Column) -> Column:
    """The first listed country, not the expected one, that a text names; null where there is none. Both in their :func:`label_text` form, the text with a blank at each end."""
    out = F.lit(None).cast("string")
    for name in reversed(COUNTRIES):
        others = [n.lower() for n in ALIASES.get(name, [])]
        same = (own == name.lower()) | own.isin(others) if others else own == name.lower()
        out = F.when(have.contains(f" {name.lower()} ") & ~same, name).otherwise(out)
    return out


def heading_share(c: Column) -> Column:
    """The part of a line that the warning's heading takes, up to its colon or its words; from 0.05 to 1."""
    raw = strip(c)
    at, n = F.instr(raw, ":"), F.greatest(F.length(raw), F.lit(1))
    letters = F.regexp_replace(F.upper(raw), r"[^\p{L}]", "")
    spread = F.regexp_extract(raw, "(?i)^(.*?" + r"\P{L}*".join("GOVERNMENTWARNING") + ")", 1)
    share = F.when(at > 0, at / n).when(spread != "", F.length(spread) / n).when(F.length(letters) > 17, 17.0 / F.length(letters)).otherwise(1.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), share))


def overlap(a: Column, b: Column) -> Column:
    """Shared words of a over all of a's."""
    x, y = tokens(a), tokens(b)
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def box_bounds(box: Column) -> Column:
    """Least and greatest x and y of a box's points."""
    x, y = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def warning_signals(c: Column) -> Column:
    heading = warning_heading(c)
    return F.struct(
        heading.isNotNull().alias("has_heading"), text(c).rlike(r"(?U)GOVERNMENT\s+WARNING\s*:").alias("is_upper"), F.coalesce(warning_block(c) == WARNING, F.lit(False)).alias("is_exact")
    )
