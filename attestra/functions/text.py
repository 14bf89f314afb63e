"""Normalisers and derived text columns. All are JVM expressions but :func:`decomposed`."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists of the product families, in the order they are tried.
WINE = ["WINE", "CHAMPAGNE", "CIDER", "MEAD", "SANGRIA", "SAKE"]
SPIRITS = ["WHISK", "VODKA", "GIN", "RUM", "TEQUILA", "MEZCAL", "LIQUEUR", "BRANDY", "COGNAC", "CORDIAL", "SPIRIT", "BOURBON", "SCOTCH"]
MALT = ["ALE", "LAGER", "MALT", "BEER", "STOUT", "PORTER", "PILSNER"]
#: Spellings of units of volume.
UNIT_SPELLINGS = {
    "mL": ["milliliter", "milliliters", "ml"],
    "L": ["liter", "liters", "l"],
    "fl oz": ["fluid ounce", "fluid ounces", "fl oz"],
    "oz": ["ounce", "ounces"],
    "Pint": ["pint"],
    "Pints": ["pints"],
    "gal": ["gallon", "gallons"],
}
#: Origins that are not imports: states, the capital's district and one territory.
US_ORIGINS = [
    "ALABAMA", "ALASKA", "ARIZONA", "ARKANSAS", "CALIFORNIA", "COLORADO", "CONNECTICUT", "DELAWARE", "DISTRICT OF COLUMBIA", "FLORIDA", "GEORGIA", "HAWAII", "IDAHO", "ILLINOIS", "INDIANA", "IOWA", "KANSAS", "KENTUCKY",
    "LOUISIANA", "MAINE", "MARYLAND", "MASSACHUSETTS", "MICHIGAN", "MINNESOTA", "MISSISSIPPI", "MISSOURI", "MONTANA", "NEBRASKA", "NEVADA", "NEW HAMPSHIRE", "NEW JERSEY", "NEW MEXICO", "NEW YORK", "NORTH CAROLINA",
    "NORTH DAKOTA", "OHIO", "OKLAHOMA", "OREGON", "PENNSYLVANIA", "PUERTO RICO", "RHODE ISLAND", "SOUTH CAROLINA", "SOUTH DAKOTA", "TENNESSEE", "TEXAS", "UTAH", "VERMONT", "VIRGINIA", "WASHINGTON", "WEST VIRGINIA", "WISCONSIN", "WYOMING",
]
TRUE_WORDS, FALSE_WORDS = ["1", "true", "yes", "y"], ["", "0", "false", "no", "n"]
FORM_TRUE_WORDS = ["1", "true", "yes", "on"]
#: White space of Unicode, as text is stripped and split by it elsewhere.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The same as the inside of a pattern's class, by ranges, which are much faster than single signs.
WHITE_CLASS = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: One such sign, for a scan of a text: one comparison rules out visible ASCII before the ranges are tried.
WHITE_SIGN = f"[[^!-~]&&[{WHITE_CLASS}]]"
#: Runs of white space that one blank is not already.
_NOT_COLLAPSED = f" {WHITE_SIGN}+|[[^ -~]&&[{WHITE_CLASS}]]{WHITE_SIGN}*"


def _folds() -> tuple[str, str, str]:
    """Characters whose compatibility decomposition is one ASCII letter or digit and marks, those letters, and which of them have marks."""
    whole, letters, marked = [], [], []
    for c in map(chr, [*range(0xA0, 0x3000), *range(0xFF10, 0xFF5B)]):
        first, *rest = unicodedata.normalize("NFKD", c)
        if first.isascii() and first.isalnum() and all(unicodedata.combining(x) for x in rest):
            whole.append(c)
            letters.append(first)
            if rest:
                marked.append(c)
    return "".join(whole), "".join(letters), "".join(marked)


FOLDED, FOLDED_TO, MARKED = _folds()
#: Stand-ins, side by side in a range for private use, of letters and digits that had marks.
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_STANDINS = "".join(chr(0xE000 + i) for i in range(len(_PLAIN)))
_TO_STANDINS = "".join(_STANDINS[_PLAIN.index(to)] if c in MARKED else to for c, to in zip(FOLDED, FOLDED_TO, strict=True))
#: What stands for itself in that range, to a sign that is no letter either.
_NOTHING = "\ufffd" * len(_STANDINS)


def text(c: Column) -> Column:
    """Null becomes empty."""
    return F.coalesce(c, F.lit(""))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once: what a lambda uses from outside would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends; null becomes empty. A text between two visible ASCII signs is left as it is, as trimming is dear."""
    ends = [F.substring(text(c), at, 1).between("!", "~") for at in (1, -1)]
    return F.when(ends[0] & ends[1], c).otherwise(F.btrim(text(c), F.lit(WHITE)))


def folded(c: Column) -> Column:
    """Accented and wide letters and digits as ASCII, each mark as a space, which is what decomposition leaves of them.

    Signs that decompose into several letters are left out; :func:`decomposed` has all.
    """
    marked = F.regexp_replace(F.translate(c, _STANDINS + FOLDED, _NOTHING + _TO_STANDINS), f"[{_STANDINS[0]}-{_STANDINS[-1]}]", "$0 ")
    return F.when(F.length(c) != F.octet_length(c), F.translate(marked, _STANDINS, _PLAIN)).otherwise(c)


def label_text(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, one space between; accented letters are decomposed before."""
    return F.array_join(label_words(c), " ")


def label_words(c: Column) -> Column:
    """The words of :func:`label_text`. In ASCII, signs become blanks one by one, which is faster than a pattern."""
    kept = F.lit(None).cast("string")
    signs = F.mask(text(c), kept, kept, kept, F.lit(" "))
    plain = F.regexp_replace(folded(text(c)), r"\P{Alnum}+", " ")
    return F.array_remove(F.split(F.lower(F.when(F.length(text(c)) == F.octet_length(text(c)), signs).otherwise(plain)), " "), "")


def decomposed(c: Column) -> Column:
    """Compatibility decomposition (NFKD), for which there is no built-in function; made where a session is at hand."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield v.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(c)


def collapsed(c: Column) -> Column:
    """White space collapsed to single spaces; case and punctuation stay."""
    return F.trim(F.regexp_replace(text(c), _NOT_COLLAPSED, " "))


def falsy_collapsed(c: Column) -> Column:
    """The same, with ``0`` taken as nothing."""
    out = collapsed(c)
    return F.when(out == "0", "").otherwise(out)


def unquoted(c: Column) -> Column:
    """Spreadsheet quotes round a number go: ``'123'`` is 123."""
    return F.regexp_replace(strip(c), r"^'(\d+)'?$", "$1")


def lines(c: Column) -> Column:
    """Lines with blanks collapsed, without empty ones."""
    split = F.transform(F.split(text(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return F.filter(split, lambda x: x != "")


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *map(collapsed, parts)), 256), 1, 16)


def stable_int(*parts: Column) -> Column:
    """The first 12 hex digits of the hash, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12), 16, 10).cast("bigint")


def order_hash(seed: str, *keys: Column) -> Column:
    """Sorts rows in an order that depends on the seed and their keys alone."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]), 256)


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_prefix(c: Column) -> Column:
    return F.when(F.length(text(c)) >= 7, F.substring(c, 1, 7)).otherwise("unknown")


def registry_date(c: Column) -> Column:
    """``MM/dd/yyyy`` text as a date, null where it is none."""
    return F.try_to_date(c, "MM/dd/yyyy")


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def product_family(c: Column) -> Column:
    upper = F.upper(text(c))
    return F.when(contains_any(upper, WINE), "wine").when(contains_any(upper, SPIRITS), "distilled_spirits").when(contains_any(upper, MALT), "malt_beverage").otherwise("other")


def origin_bucket(origin: Column, domestic: list[str], permit: Column | None = None) -> Column:
    """Imported where the permit says so, or an origin is named that is not domestic."""
    named = F.upper(F.trim(text(origin)))
    out = F.when((named != "") & ~named.isin(domestic), "imported").otherwise("domestic")
    return out if permit is None else F.when(text(permit).contains("-I-"), "imported").otherwise(out)


def source_bucket(permit: Column, origin: Column) -> Column:
    """Imported by an importer's permit, whatever its case, or an origin that is named and not among :data:`US_ORIGINS`."""
    return origin_bucket(origin, US_ORIGINS, F.upper(text(permit)))


def image_bucket(n: Column) -> Column:
    return F.when(n <= 0, "none").when(n == 1, "single").otherwise("multi")


def stratum(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def parsed_bool(c: Column) -> Column:
    """True, false, or null for a value that is neither."""
    low = F.lower(strip(c))
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def form_bool(c: Column) -> Column:
    return F.lower(strip(c)).isin(FORM_TRUE_WORDS)


def trimmed_number(c: Column) -> Column:
    """``750.0`` as 750, ``12.50`` as 12.5."""
    return F.regexp_replace(F.regexp_replace(text(c.cast("string")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def alcohol_text(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.concat(trimmed_number(c), F.lit("% ALC/VOL")))


def contents_text(amount: Column, unit: Column) -> Column:
    spelt = F.create_map(*[F.lit(x) for spelling, names in UNIT_SPELLINGS.items() for name in names for x in (name, spelling)])
    return F.when(amount.isNull(), "").otherwise(F.trim(F.concat_ws(" ", trimmed_number(amount), F.coalesce(F.try_element_at(spelt, F.lower(F.trim(text(unit)))), F.trim(text(unit))))))


def panel_files(c: Column) -> Column:
    """Names parted by ``|`` if there is one, else by ``;``."""
    split = F.when(text(c).contains("|"), F.split(c, r"\|")).otherwise(F.split(text(c), ";"))
    return F.filter(F.transform(split, lambda x: strip(x)), lambda x: x != "")


def item_files(panels: Column, filename: Column) -> Column:
    return F.when(F.size(panels) > 0, panels).otherwise(F.array(filename))


def display_value(c: Column, kind: str = "text") -> Column:
    if kind == "bool":
        return F.when(c, "Yes").otherwise("No")
    shown = strip(c.cast("string"))
    if kind == "title":
        shown = F.initcap(F.regexp_replace(shown, "_", " "))
    return F.when(shown == "", "Not provided").otherwise(shown)


def compact(c: Column, most: int = 240) -> Column:
    out = collapsed(c)
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 1), F.lit("..."))).otherwise(out)


def evidence_window(c: Column, needle: Column, around: int) -> Column:
    """The characters round the first hit, whatever its case; the beginning where there is none."""
    at = F.instr(F.lower(text(c)), F.lower(text(needle)))
    first = F.greatest(F.lit(1), at - around)
    hit = F.substring(c, first, F.least(at - 1, F.lit(around)) + F.length(text(needle)) + around)
    return collapsed(F.when(at > 0, hit).otherwise(F.substring(text(c), 1, 2 * around)))


def duration_text(seconds: Column) -> Column:
    """Milliseconds below a second, seconds below a minute, else minutes and seconds."""
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 1, F.concat(F.format_string("%.0f", seconds * 1000), F.lit(" ms")))
        .when(seconds < 60, F.concat(F.format_string("%.2f", seconds), F.lit(" s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), F.format_string("%.1f", seconds - minutes * 60), F.lit("s")))
    )


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")


def parent_folder(c: Column) -> Column:
    return F.try_element_at(F.split(c, "/"), F.lit(-2))


def safe_name(c: Column) -> Column:
    """Letters, digits, dot, dash and underscore; anything else is an underscore."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def word_windows(c: Column, most: int, overlap: int) -> Column:
    """Overlapping windows of words; the last one reaches the end."""
    words, step = F.filter(F.split(collapsed(c), " "), lambda x: x != ""), max(1, most - overlap)
    n = F.size(words)
    last = F.when(n <= most, 0).otherwise(F.ceil((n - most) / step)).cast("int")
    out = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, most), " "))
    return F.when(n > 0, out).otherwise(F.array().cast("array<string>"))


def first_line(c: Column) -> Column:
    return F.coalesce(F.try_element_at(lines(c), F.lit(1)), F.lit(""))


def used_on_label(c: Column) -> Column:
    """The line marked as the name used on the label, else the first one."""
    marked = strip(F.regexp_extract(F.concat(F.lit("\n"), text(c)), r"\n([^\n]+?)\s*\(Used on label\)", 1))
    return F.when(marked != "", marked).otherwise(first_line(c))


def entity_word(c: Column) -> Column:
    return strip(F.replace(text(c), F.lit("##"), F.lit("")))


def entity_group(c: Column) -> Column:
    return F.regexp_replace(F.lower(text(c)), "^[bi]-", "")
