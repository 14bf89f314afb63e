"""URL filters: rules first, then a ratio of character language models.

A rule names a host and the start of a path; it holds for the host and all its
subdomains, and the longest one that fits decides. The other URLs are judged by
two smoothed Markov models of variable order, one of accepted and one of rejected
URLs: each character's probability mixes what all its contexts of up to
``ORDER`` characters have seen (Witten-Bell weights: a context counts for more,
the more often and the less variously it was followed). The difference of the
two log-likelihoods, divided by the number of characters, is held against a
threshold calibrated on labelled URLs that the models have not seen.

Labelled URLs are those that rules decide, unless a column says otherwise; at
most ``SAMPLE`` of each label, by a hash of the URL, train and calibrate the
models. Every URL is judged.

Edge cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule, and has score 0; without labels of both kinds nothing is blocked
by score; of an allowing and a blocking rule of equal length, the blocking one
holds; repeated rows get equal verdicts; a URL of any length is judged
whole; extra columns are passed by.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, thinned

ORDER, SAMPLE = 5, 20_000
#: Every n-th labelled URL, by hash, calibrates instead of training.
CALIBRATE = 4
_START, _END = "\x02", "\x03"
#: Characters assumed possible beyond those seen.
ALPHABET = 256
ALLOW, BLOCK = "allow", "block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where there is no ``://``."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, rest, 1), _UPPER, _LOWER), F.regexp_extract(url, rest, 2)


def rule_for(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """The rule (host and path as one string) that decides, and its verdict; null where none fits.

    ``rules`` are (verdict, host with path) such as ("block", "com/en/").
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK)):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


class Markov:
    """Character model of variable order with Witten-Bell smoothing."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        self.seen: dict[str, Counter] = defaultdict(Counter)
        for text in texts:
            line = _START * order + text + _END
            for i in range(order, len(line)):
                for n in range(order + 1):
                    self.seen[line[i - n : i]][line[i]] += 1
        self.totals = {context: sum(c.values()) for context, c in self.seen.items()}
        self.known: dict[tuple[str, str], float] = {}

    def probability(self, context: str, char: str) -> float:
        """Mixes all contexts; over all characters it sums to one."""
        p = 1 / ALPHABET
        for n in range(len(context) + 1):
            tail = context[len(context) - n :]
            total = self.totals.get(tail)
            if not total:
                break
            followers = self.seen[tail]
            p = (followers.get(char, 0) + len(followers) * p) / (total + len(followers))
        return p

    def log_likelihood(self, text: str) -> float:
        line, known, order, sum_ = _START * self.order + text + _END, self.known, self.order, 0.0
        for i in range(order, len(line)):
            key = line[i - order : i], line[i]
            value = known.get(key)
            if value is None:
                value = math.log(self.probability(*key))
                if len(known) < 1 << 18:
                    known[key] = value
            sum_ += value
        return sum_


class Ratio:
    """Two models and the threshold between them."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER, calibrate: int = CALIBRATE):
        def parts(texts: list[str]) -> tuple[list[str], list[str]]:
            held = texts[::calibrate] if len(texts) >= 2 * calibrate else texts
            return [t for i, t in enumerate(texts) if i % calibrate] or texts, held

        self.models, self.threshold = None, 0.0
        if accepted and rejected:
            (good, good_held), (bad, bad_held) = parts(accepted), parts(rejected)
            self.models = Markov(good, order), Markov(bad, order)
            self.threshold = best_threshold([self.score(t) for t in good_held], [self.score(t) for t in bad_held])

    def score(self, text: str) -> float:
        if not self.models or not text:
            return 0.0
        good, bad = self.models
        return (good.log_likelihood(text) - bad.log_likelihood(text)) / (len(text) + 1)

    def accepts(self, score: float) -> bool:
        return not self.models or score >= self.threshold


def best_threshold(good: list[float], bad: list[float]) -> float:
    """Between two neighbouring scores, with the best mean of both classes' accuracy; the middle of equally good ones."""
    marked = sorted([(s, 1) for s in good] + [(s, 0) for s in bad])
    right, best, at = 1.0, -1.0, [0.0]
    for i, (score, kind) in enumerate(marked):
        if not i or score != marked[i - 1][0]:
            here = score if not i else (score + marked[i - 1][0]) / 2
            if right > best + 1e-12:
                best, at = right, [here]
            elif right > best - 1e-12:
                at.append(here)
        right += -1 / len(good) if kind else 1 / len(bad)
    return at[len(at) // 2]


def labelled_sample(urls: DataFrame, text: str, label: str, sample: int = SAMPLE) -> dict[str, list[str]]:
    """At most ``sample`` different texts of each label, in the order of a hash."""
    known = urls.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("order"))
    sizes = {r["label"]: r["n"] for r in urls.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.approx_count_distinct(text).alias("n")).collect()}
    known = thinned(known, "label", "order", sizes, sample).distinct()
    ranked = known.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("order", "text"))).where(F.col("n") <= sample)
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: r["n"]):
        out.setdefault(r["label"], []).append(r["text"])
    return out


def judged(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row."""
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    split = split.select("_id", "host", "path", rule.alias("rule"), says.alias("_says"), F.concat("host", "path").alias("_text"))
    labels = labelled_sample(split, "_text", "_says", sample)
    ratio = pages.sparkSession.sparkContext.broadcast((labels.get(ALLOW, []), labels.get(BLOCK, []), order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _fitted(ratio.value)
        for batch in batches:
            for part in slices(batch, "_text"):
                scores = [judge.score(t) for t in part.column("_text").to_pylist()]
                verdicts = [says or (ALLOW if judge.accepts(s) else BLOCK) for s, says in zip(scores, part.column("_says").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["_id", "host", "path", "rule", "verdict", "score"])

    kind = split.schema["_id"].dataType.simpleString()
    return split.mapInArrow(run, f"_id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("_id", id_col)


_FITTED: dict = {}


def _fitted(value: tuple) -> Ratio:
    """The models, fitted once in a worker for the same labelled URLs."""
    mark = hash((tuple(value[0]), tuple(value[1]), value[2]))
    if mark not in _FITTED:
        _FITTED.clear()
        _FITTED[mark] = Ratio(*value)
    return _FITTED[mark]
