"""The registered queries on the smallest tables against brute force or SQL."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from attestra.llm import byte_bpe, layout, packing, ppm, queries, urls

from .test_operators import JSON, PATTERN, RANKS, found_edit_checks, in_order, plain_edit_checks, slow_best_fit, slow_cover, slow_fingerprint, slow_groups, slow_ppm

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def read(name: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{DIR}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return [(i, t or "") for i, t in read("documents", "doc_id, text")]


def fold(i, parts: int) -> int:
    return zlib.crc32(str(i).encode()) % parts


# Rules of the contract, written out as SQL: the host's and path's beginning, the longest first.
RULES_SQL = f"""WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM '{DIR}/pages.parquet'),
  h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  rules(says, own, start) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
  m AS (SELECT h.*, own || start AS rule, says, row_number() OVER (PARTITION BY page_id ORDER BY length(own || start) DESC) AS k FROM h LEFT JOIN rules ON (host = own OR suffix(host, '.' || own)) AND starts_with(path, start))
  SELECT page_id, host, path, rule, says FROM m WHERE k = 1"""


def slow_likelihood(lines: list[str], text: str, order: int) -> float:
    """Witten-Bell by its definition: each context's share of its followers, the rest by the shorter context."""
    lines = [urls._START * order + x + urls._END for x in lines]

    def probability(context: str, char: str) -> float:
        p = 1 / urls.ALPHABET
        for n in range(order + 1):
            tail = context[order - n :]
            followers = collections.Counter(x[i] for x in lines for i in range(order, len(x)) if x[i - n : i] == tail)
            if not followers:
                return p
            total = sum(followers.values())
            p = (followers[char] + len(followers) * p) / (total + len(followers))
        return p

    line = urls._START * order + text + urls._END
    return sum(math.log(probability(line[i - order : i], line[i])) for i in range(order, len(line)))


def test_op1(spark):
    got = {r.page_id: r for r in queries.op1_url_ratio(spark, DIR).collect()}
    want = duckdb.sql(RULES_SQL).fetchall()
    assert len(got) == len(want)
    for page, host, path, rule, says in want:
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (says is None or r.verdict == says)
    accepted = sorted({h + p for _, h, p, _, s in want if s == "allow"})[:8]
    rejected = sorted({h + p for _, h, p, _, s in want if s == "block"})[:8]
    ratio = urls.Ratio(accepted, rejected, 3, calibrate=10**6)
    for text in [accepted[0], rejected[1], "unseen.example/x?y"]:
        plain = (slow_likelihood(accepted[1:], text, 3) - slow_likelihood(rejected[1:], text, 3)) / (len(text) + 1)
        assert math.isclose(ratio.score(text), plain, rel_tol=1e-9)
    scores = {r.page_id: r for r in got.values() if r.rule is None}
    assert scores and max([r.score for r in scores.values() if r.verdict == "block"], default=-99) < min([r.score for r in scores.values() if r.verdict == "allow"], default=99)


def test_op2(spark, texts):
    assert found_edit_checks(queries.op2_scaled_sketch(spark, DIR)) == plain_edit_checks(in_order(spark, texts))


def test_op3(spark):
    langs = dict(read("documents", "doc_id, lang"))
    got = queries.op3_compression_language(spark, DIR).collect()
    assert {r.doc_id for r in got} == set(langs) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.85 * len(held)


def test_op4(spark, texts):
    got = {r.doc_id: r for r in queries.op4_ppm(spark, DIR).collect()}
    train = [t.encode().lower() for i, t in texts if fold(i, 5) != 1]
    counts = collections.Counter(w for t in train for w in [*t.split(), b" "])
    n, v, end = sum(counts.values()), len(counts), bytes([ppm.END])
    short = sorted(texts, key=lambda x: len(x[1]))[:6]
    levels = [collections.defaultdict(int) for _ in range(ppm.ORDER + 1)]
    for t in train:
        line = end * ppm.ORDER + t + end
        for i in range(ppm.ORDER, len(line)):
            for o in range(ppm.ORDER + 1):
                levels[o][line[i - o : i], line[i]] += 1
    seen = [collections.defaultdict(dict) for _ in levels]
    for o, level in enumerate(levels):
        for (c, s), k in level.items():
            seen[o][c][s] = k
    for i, t in texts:
        w, r = [*t.encode().lower().split(), b" "], got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, fold(i, 5) == 1)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    for i, t in [*short, *sorted((x for x in texts if 150 <= len(x[1].encode()) <= 400), key=lambda x: x[0])[:6]]:
        line = end * ppm.ORDER + t.encode().lower() + end
        if len(t.encode()) <= 400:
            plain = 0.0
            for at in range(ppm.ORDER, len(line)):
                own = [{(line[at - o : at], s): k for s, k in seen[o].get(line[at - o : at], {}).items()} for o in range(ppm.ORDER + 1)]
                plain += slow_ppm(own, line, at)
            assert math.isclose(got[i].score, plain * math.log10(2), rel_tol=1e-6)


def test_op5(spark, texts):
    truth = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.content(RANKS)[1]), special_tokens={})
    want = {}
    for i, t in texts:
        ids = truth.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_byte_bpe(spark, DIR).collect()} == want


def test_op6(spark, texts):
    prints = {i: slow_fingerprint(t) for i, t in texts}
    groups = slow_groups(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, DIR).collect()} == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


def test_op7(spark):
    pages = dict(read("pages", "page_id, html"))
    got = {r.page_id: r.text for r in queries.op7_layout_text(spark, DIR).collect()}
    assert got == {i: layout.page_text(h) for i, h in pages.items()} and any(got.values())


def test_op7_shows_the_words_that_tags_leave(spark):
    """By patterns alone, without the tree builder: what is left of a page without its head, scripts and comments, in order, and list items as lines."""
    got = {r.page_id: r.text for r in queries.op7_layout_text(spark, DIR).collect()}
    for i, page in read("pages", "page_id, html"):
        shown = re.sub(r"(?is)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>", " ", page or "")
        items = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.findall(r"(?is)<li>(.*?)</li>", shown)]
        words = html.unescape(re.sub("<[^>]*>", " ", re.sub(r"(?i)</?(?:a|b|i|em|span)\b[^>]*>", "", shown))).split()
        lines = got[i].split("\n")
        assert [w for w in got[i].split() if w != "-"] == [w for w in words if w != "-"]
        assert [x[2:] for x in map(str.strip, lines) if x.startswith("- ")] == items


def test_op8(spark, texts):
    covers = slow_cover([t.encode() for _, t in texts], 35)
    want = {i: (len(t.encode().split()), gone, hashlib.sha256(b" ".join(kept)).hexdigest()) for (i, t), (kept, gone) in zip(texts, covers, strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op8_substring_dedup(spark, DIR).collect()} == want


def test_op9(spark):
    rows = read("embeddings", "vec_id, embedding")
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = collections.defaultdict(list)
    for r in queries.op9_stable_knn(spark, DIR).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        scores = x @ x[ids == q][0]
        truth = {i for _, i in sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q)[:20]}
        hits += len(truth & {i for _, i, _ in got[q]})
        assert sorted(k for k, *_ in got[q]) == list(range(1, 1 + min(20, len(ids) - 1)))
    assert hits >= 0.9 * 20 * len(got) and set(got) == set(ids[ids % 20 == 0].tolist())


def test_op10(spark, texts):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want = {}
    for i, t in texts:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        for p, (a, n) in enumerate(packing.cuts(len(ids), 1024)):
            want[i, p] = (a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()))
    got = queries.op10_best_fit(spark, DIR).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == slow_best_fit([n for _, n, _ in want.values()], 1024)
