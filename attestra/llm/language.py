"""Language identification by compression.

For each language a raw-content zstandard dictionary is put together from a
bounded sample of labelled texts. A text is cut into pieces of about
``PIECE`` bytes at character bounds, so that it cannot learn its own language
from itself; each piece is compressed with every dictionary, and the language of
the smallest total wins. The margin to the second, relative to its size, gives
the score; a narrow margin rejects the text. Case is folded on both sides. Where the margin is narrow, or the text shorter than ``SHORT`` bytes, whole
bytes are too coarse: then what counts is what the text adds to ``PRIMERS``
primers of each language, which tell the coder the language's letters, too.

The sample: texts in the order of a hash of text and id, up to ``DOCS`` of them
and ``SAMPLE`` characters of a language together, whole but for those longer than
``LONGEST`` characters, of which the middle part teaches (many excerpts teach more
than few whole texts, as labels have errors; ``longest=None``: whole, too). Every label is learned (``languages=n``: the n with most texts only); its sample
and compressors take some MB each. These bounds hold for training only; every text is classified whole. :func:`crossed` learns for each
half of the texts from the other half, so that none meets itself.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; so is every text where nothing was learned; with one learned language
every text with a letter is of it, with score 1; ties go to the
language with the larger sample, then the first in order; repeated rows get equal results; rows without a label
or text teach nothing; extra columns are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, slices, thinned

DOCS, SAMPLE, LONGEST, PIECE = 400, 240_000, 600, 4096
LEVEL, SHORT = 3, 256
FINE_LEVEL, PRIMER, PRIMERS = 12, 1500, 6
#: The score of a relative margin m is m / (m + HALF).
HALF = 0.02
#: Texts whose score is below are rejected: their margin is under a two-hundredth of their size.
REJECT = 0.2
#: Margins below this are measured again with primers.
FINER = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = DOCS, sample: int = SAMPLE, longest: int | None = LONGEST, languages: int | None = None) -> dict[str, bytes]:
    """Training text of each language; about ``sample`` characters of it, which the last text taken may exceed."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    part = F.col(text_col)
    if longest:
        middle = F.floor((F.length(part) - longest) / 2).cast("int")
        part = F.when(F.length(part) > longest, F.substring(part, F.greatest(F.lit(1), middle), F.lit(longest))).otherwise(part)
    known = known.select(F.col(lang_col).alias("lang"), part.alias("part"), F.xxhash64(text_col, id_col).alias("order"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    counts = counts if languages is None else counts.limit(languages)
    known = thinned(known, "lang", "order", {r["lang"]: r["n"] for r in counts.collect()}, docs_each)
    order = Window.partitionBy("lang").orderBy("order", "part")
    ranked = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_each)
    before = F.coalesce(F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.withColumn("before", before).where(F.col("before") < sample).collect(), key=lambda r: (r["lang"], -r["n"])):
        out.setdefault(r["lang"], []).append(r["part"])
    return {lang: "\n".join(parts).encode() for lang, parts in out.items()}


class Classifier:
    """Compressors with a dictionary for each language."""

    def __init__(self, training: dict[str, bytes], level: int = LEVEL, piece: int = PIECE, short: int = SHORT, fine_level: int = FINE_LEVEL):
        training = {lang: text.decode().lower().encode() for lang, text in training.items()}
        self.languages = sorted(training, key=lambda lang: (-len(training[lang]), lang))
        self.piece, self.short = piece, short
        self.ready, self.primed = [], []
        for lang in self.languages:
            compress = self._compressor(training[lang], level, 2 * piece)
            self.ready.append(compress)
            text = training[lang]
            parts = [text[at : at + PRIMER] for at in range(0, len(text), max(1, len(text) // PRIMERS))][:PRIMERS]
            rest = self._compressor(text, fine_level, 2 * piece + PRIMER)
            self.primed.append((rest, [(part, len(rest(part))) for part in parts]))

    @staticmethod
    def _compressor(content: bytes, level: int, most: int):
        """For texts of up to about ``most`` bytes; a compressor takes memory by that."""
        options = zstandard.ZstdCompressionParameters.from_level(level, source_size=most, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=options)
        return zstandard.ZstdCompressor(dict_data=content, compression_params=options).compress

    def sizes(self, text: bytes) -> list[int]:
        """Compressed bytes of a lower-cased text with each language's dictionary."""
        parts = self.pieces(text)
        return [sum([len(compress(p)) for p in parts]) for compress in self.ready]

    def finer_sizes(self, text: bytes) -> list[int]:
        """Bytes that a text adds to primers of each language, which tell the coder its letters; a sum over all primers."""
        parts = self.pieces(text)
        return [sum([len(compress(primer + part)) - alone for primer, alone in primers for part in parts]) for compress, primers in self.primed]

    def pieces(self, text: bytes) -> list[bytes]:
        """Pieces of equal length, give or take a byte of a character."""
        n = max(1, round(len(text) / self.piece))
        if n == 1:
            return [text]
        cuts = [len(text) * i // n for i in range(n + 1)]
        for i in range(1, n):
            while cuts[i] < len(text) and text[cuts[i]] & 0xC0 == 0x80:
                cuts[i] += 1
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language of a text, or ``und``, and a score from 0 to 1."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        folded = text.lower().encode()
        lang, margin = self._least(self.sizes(folded)) if len(folded) >= self.short else ("", 0.0)
        if margin < FINER:
            lang, margin = self._least(self.finer_sizes(folded))
        return lang, 1.0 if margin == math.inf else margin / (margin + HALF)

    def _least(self, sizes: list[int]) -> tuple[str, float]:
        best = min(sizes)
        rest = sorted(sizes)[1:]
        return self.languages[sizes.index(best)], (rest[0] - best) / rest[0] if rest else math.inf


def classified(docs: DataFrame, training: dict[str, bytes], text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (the margin is narrow, or there is no letter)."""
    shipped = docs.sparkSession.sparkContext.broadcast(training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = None
        for batch in batches:
            classify = classify or Classifier(shipped.value)
            for part in slices(batch, text_col):
                found = [classify(t) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64()), pa.array([y < reject for _, y in found], pa.bool_())],
                    [*part.schema.names, *added])

    added = ["lang_pred", "score", "rejected"]
    if clash := set(added) & set(docs.columns):
        docs = docs.drop(*clash)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2) -> DataFrame:
    """Languages of all rows, learned from those outside one fold, which is ``held_out``."""
    held = crc_fold(id_col, parts) == part
    training = samples(docs.where(~held), id_col, text_col, lang_col)
    rows = classified(docs.select(id_col, text_col, held.alias("held_out")), training, text_col)
    return rows.select(id_col, "held_out", "lang_pred", "score", "rejected")


def crossed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """:func:`classified`, each half of the texts (copies together, by a hash) by what the other half teaches."""
    half = F.pmod(F.xxhash64(text_col), F.lit(2))
    taught = [samples(docs.where(half != i), id_col, text_col, lang_col) for i in (0, 1)]
    if not all(taught):
        #: So few texts that a half has none with a label.
        taught = [taught[0] or taught[1]] * 2
    return classified(docs.where(half == 0), taught[0], text_col).unionByName(classified(docs.where(half == 1), taught[1], text_col))
