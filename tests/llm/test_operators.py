from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from attestra.llm import byte_bpe, language, layout, packing, ppm, simhash, sketches, stable_knn, substrings, urls

from .helpers import SCHEMA, awkward, documents, prose

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "org/es/")]
PATTERN = public_tokenizers.PATTERN
RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, awkward()).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- URL filters


def test_url_rules_and_models(spark):
    rows = [(i, f"https://www.good{i % 7}.example.com/en/7{i}") for i in range(40)] + [(100 + i, f"http://Spam{i % 5}.Example.ORG/es/{i}?q#f") for i in range(40)]
    rows += [(200, None), (201, "no scheme"), (202, "x://"), (203, "ftp://host:8080"), (204, "https://www.good1.example.com/fr/71"), (205, "http://spam2.example.org/fr/3"), (205, "http://spam2.example.org/fr/3"), (None, "a://b.com/en/x")]
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u in rows], "page_id bigint, url string, host int, verdict string")
    got = {r.page_id: r for r in urls.judged(pages, RULES).collect()}
    assert len(urls.judged(pages, RULES).collect()) == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.good1.example.com", "/en/71", "example.com/en/7", "allow")
    assert (got[101].host, got[101].path, got[101].rule, got[101].verdict) == ("spam1.example.org", "/es/1", "org/es/", "block")
    assert (got[200].host, got[200].path, got[200].rule) == ("", "", None) and got[201].host == "" and got[202].host == ""
    assert (got[203].host, got[203].path) == ("host:8080", "")
    assert got[204].verdict == "allow" and got[205].verdict == "block" and got[None].rule == "com/en/"
    assert urls.judged(pages.limit(0), RULES).count() == 0


def test_markov_sums_to_one_and_threshold_parts():
    model = urls.Markov(["abc/def", "abd/xyz", "abc"], 3)
    seen = {c for counts in model.seen.values() for c in counts}
    for context in ("abc", "zzz", "\x02ab"):
        unseen = urls.ALPHABET - len(seen)
        assert math.isclose(sum(model.probability(context, c) for c in seen) + unseen * model.probability(context, "\u2603"), 1, abs_tol=1e-9)
    assert 1.0 < urls.best_threshold([2.0, 3.0], [0.0, 1.0]) <= 2.0


# ---- fingerprints


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_sketch(text: str, k: int = 5, fraction: float = sketches.FRACTION) -> set[int]:
    """By sets, without arrays: the hashes of whole shingles below the fraction."""
    base, h = sketches._BASE, [xxhash.xxh3_64_intdigest(w, 0) for w in text.encode().lower().split()]
    runs = [h[i : i + k] for i in range(max(1, len(h) - k + 1))] if h else []
    out = set()
    for run in runs:
        value = 0
        for x in run:
            value = (value * base + x) % 2**64
        value = int(sketches.mixed(np.array([value], np.uint64))[0])
        out.add(int(sketches.mixed(np.array([value ^ len(run)], np.uint64))[0]) if len(run) < k else value)
    return {v for v in out if v < int(fraction * 2**64)}


def plain_edit_checks(rows: list[tuple]) -> collections.Counter:
    """What edit_checks returns for rows in order of id and tie."""
    out = collections.Counter()
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        spell = lambda s: "".join(f"{v:016x}" for v in sorted(s))
        out[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(a), spell(b), round(jaccard(a, b) if a and b else float(len(a) == len(b)), 9), round(jaccard(a, c) if a and c else float(len(a) == len(c)), 9)] += 1
    return out


def found_edit_checks(df) -> collections.Counter:
    return collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def in_order(spark, rows: list[tuple]) -> list[tuple]:
    """Rows by id (null first) and the hash of their text."""
    ties = [r.tie for r in spark.createDataFrame([(n, t or "") for n, (_, t) in enumerate(rows)], "n int, t string").selectExpr("n", "xxhash64(t) AS tie").orderBy("n").collect()]
    return [(i, t or "") for (i, t), _ in sorted(zip(rows, ties, strict=True), key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))]


def test_sketches_equal_brute_force(spark, docs, nothing):
    assert found_edit_checks(sketches.edit_checks(docs)) == plain_edit_checks(in_order(spark, awkward()))
    r = random.Random(2)
    hot = [(r.choice([5, 5, 5, i]), prose(i % 9, r.randint(0, 30))) for i in range(300)] + [(None, prose(i, 6)) for i in range(40)]
    got = found_edit_checks(sketches.edit_checks(documents(spark, hot).repartition(5)))
    assert got == plain_edit_checks(in_order(spark, hot))
    assert sketches.edit_checks(nothing).count() == 0
    single = sketches.edit_checks(documents(spark, [(3, "one two three")])).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"one two" + b"one tw").hexdigest()


def test_sketches_of_string_ids(spark):
    rows = [(f"id{i % 50}", prose(i, 20)) for i in range(120)] + [(None, "a b")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sketches.edit_checks(df).collect()
    assert len(got) == 121 and {r.doc_id for r in got} == {i for i, _ in rows}
    prints = {(r.doc_id, r.fingerprint) for r in sketches.fingerprints(df).collect()}
    assert prints == {(r.doc_id, r.fingerprint) for r in got}


def test_sketch_algebra():
    a, b = prose(1, 3000), prose(2, 3000)
    part = " ".join(a.split()[:400])
    x, y, z = sketches.sketches([a.encode(), b.encode(), part.encode()])
    assert sketches.containment(z, x) > 0.95 and sketches.containment(x, z) < 0.3 and sketches.likeness(x, y) < 0.05
    both = sketches.merged(x, y)
    assert sketches.containment(x, both) == 1.0 and list(sketches.read(sketches.spelt(x))) == list(x)
    assert all(int(h) < sketches.FRACTION * 2**64 for h in x) and abs(len(x) / sketches.FRACTION / 2996 - 1) < 0.2


# ---- language


def test_language(spark, nothing):
    german = ["der die das und nicht ist ein zu haben werden schule straße " + prose(i, 60, 50) for i in range(30)]
    french = ["le la les des une est dans pour avec être école rue " + prose(900 + i, 60, 60)[::-1] for i in range(30)]
    rows = [(i, t) for i, t in enumerate(german + french)] + [(100, None), (101, ""), (102, "12345 !!"), (103, german[0] * 50), (104, german[3]), (104, german[3])]
    langs = ["de"] * 30 + ["fr"] * 30 + ["de", "fr", None, None, None, None]
    df = documents(spark, rows, langs)
    got = {r.doc_id: r for r in language.held_out_languages(df).collect()}
    assert all(got[i].lang_pred == ("de" if i < 30 else "fr") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0 and got[100].rejected
    assert got[103].lang_pred == got[104].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language.held_out_languages(nothing).count() == 0
    assert {r.lang_pred for r in language.classified(df, {}).collect()} == {"und"}
    kept = language.classified(df, language.samples(df))
    assert kept.count() == len(rows) and set(df.columns) <= set(kept.columns)
    whole = language.samples(df, longest=None)
    assert sum(t.encode() in whole["de"] for t in german) > 20 and german[0].encode() * 50 not in language.samples(df)["de"]
    halves = {r.doc_id: r.lang_pred for r in language.crossed(df).collect()}
    assert all(halves[i] == ("de" if i < 30 else "fr") for i in range(60)) and halves[100] == "und"
    assert language.crossed(nothing).count() == 0


def test_language_sample_is_of_texts_that_teach(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "if(id % 40 = 0, concat('wort ', id, ' und mehr'), if(id % 2 = 0, '', null)) AS text", "'de' AS lang")
    assert language.samples(df)["de"].count(b"wort") == 400
    junk = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id < 1000, 'en', concat('j', id)) AS lang")
    assert len(language.samples(junk, languages=5)) == 5 and "en" in language.samples(junk, languages=5)


def slow_language(training: dict, text: str) -> str:
    """The least sum of sizes, each piece compressed afresh with the dictionary as a prefix."""
    import zstandard

    best = {}
    for lang, content in training.items():
        total = 0
        for piece in language.Classifier({lang: content}).pieces(text.lower().encode()):
            options = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, source_size=2 * language.PIECE, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(content.decode().lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress(piece))
        best[lang] = total
    return min(best, key=best.get)


def test_language_equals_plain_compression():
    training = {lang: " ".join(prose(s + i, 200, v) for i in range(20)).encode() for lang, s, v in (("aa", 0, 40), ("bb", 500, 90), ("cc", 900, 300))}
    classify = language.Classifier(training)
    for i in range(12):
        text = prose(2000 + i, 150 + 90 * i, (40, 90, 300)[i % 3])
        lang, score = classify(text)
        assert score < language.FINER / (language.FINER + language.HALF) or lang == slow_language(training, text)


# ---- language-model scores


def test_ppm_scores(spark, docs, nothing):
    got = ppm.held_out_scores(docs).collect()
    rows = awkward()
    assert len(got) == len(rows)
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = collections.Counter(w for i, t in rows if not fold(i) for w in [*words_of(t), b" "])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in rows:
        w = [*words_of(t), b" "]
        want[i, fold(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    few = ppm.scored(docs, docs, heads=2).collect()
    assert sorted(r.n_known for r in few) == sorted(len(words_of(t)) + 1 for _, t in rows)
    assert ppm.held_out_scores(nothing).count() == 0
    assert all(math.isclose(r.score, -(len((t or "").encode()) + 1) * math.log10(256), rel_tol=1e-9) for r, t in [(ppm.scored(docs.where("doc_id = 4"), nothing).first(), "one")])


def test_ppm_keeps_every_ngram(spark):
    order, letters = ppm.ORDER, "abcdefghijklmnopqrstuvwxyz0123456789,.;:-+*/()"
    r = random.Random(5)
    texts = ["".join(r.choices(letters, k=20000)) for _ in range(30)]
    keys, counts = ppm._counted(ppm.grams([t.encode() for t in texts], order)[0])
    assert len(keys) > 1 << 19
    trie = ppm.Trie([ppm._merged([(keys & ppm._mask(o + 1), counts)]) for o in range(order + 1)])
    asked = [texts[3], texts[7][50:90] + "unseen words", "", "zz\u00e9"]
    want = [trie.log2(ppm.grams([t.lower().encode()], order)[0]).sum() * math.log10(2) for t in asked]
    train, docs = documents(spark, list(enumerate(texts))), documents(spark, list(enumerate(asked)))
    for common in (ppm.COMMON, 100):
        got = {x.doc_id: x.score for x in ppm.scored(docs, train, common=common).collect()}
        assert np.allclose([got[i] for i in range(len(asked))], want)


def slow_ppm(levels, text: bytes, at: int) -> float:
    """log2 of a symbol's probability, straight from the definition."""
    excluded, total = set(), 0.0
    for order in reversed(range(len(levels))):
        context = text[at - order : at]
        here = {s: n for (c, s), n in levels[order].items() if c == context}
        if not here:
            continue
        open_ = {s: n for s, n in here.items() if s not in excluded}
        n = sum(open_.values())
        if text[at] in open_:
            return total + math.log2((2 * open_[text[at]] - 1) / (2 * n))
        if n:
            total += math.log2(len(open_) / (2 * n))
        excluded |= set(here)
    return total - math.log2(256 - len(excluded))


def test_ppm_against_definition():
    texts, order = [b"abracadabra", b"abba cab", b"bcd"], 3
    keys, counts = ppm._counted(ppm.grams(texts, order)[0])
    arrays, levels = [], []
    for o in range(order + 1):
        short, where = np.unique(keys & ppm._mask(o + 1), return_inverse=True)
        n = np.bincount(where, counts).astype(int)
        arrays.append((short, n))
        levels.append({(int(k).to_bytes(o + 1, "big")[:-1], int(k) & 255): int(c) for k, c in zip(short, n, strict=True)})
    trie = ppm.Trie(arrays)
    for text in (b"abra", b"zab", b"", b"dcba cad"):
        line = bytes([ppm.END]) * order + text + bytes([ppm.END])
        fast = trie.log2(ppm.grams([text], order)[0])
        assert np.allclose(fast, [slow_ppm(levels, line, i) for i in range(order, len(line))])
    for context in (b"abr", b"zzz", b"cab"):
        base = np.uint64(int.from_bytes(context, "big") << 8)
        assert math.isclose(np.exp2(trie.log2(base | np.arange(256, dtype=np.uint64))).sum(), 1)


# ---- tokens


ODD = ["", " ", "  a  b", "a   b", "\n\n x", "x\n \n y", "a b ", " lead", "tab\tx y", "it's we'll 'S don't", "日本語 テスト", "é\u0301 ñ", "\x00\x01 x", "a" * 300, "\u00a0nb", "emoji \U0001f469\u200d\U0001f467 z", "\r\n a\r b", "١٢٣ 12"]


def test_byte_bpe(spark, docs, nothing):
    ranks = byte_bpe.read_ranks(byte_bpe.content(RANKS)[1])
    truth = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ready(*byte_bpe.content(RANKS), PATTERN)
    r = random.Random(1)
    cases = ODD + ["".join(r.choice("aab  \n\t'slé \u3000日!?19\u0301\U0001f600") for _ in range(r.randint(1, 30))) for _ in range(2000)]
    import pyarrow as pa

    ids, n = bpe.encode_all(pa.array(cases))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [truth.encode_ordinary(c) for c in cases]
    for c in ODD:
        one, spans, chars = bpe.offsets(c)
        assert one == truth.encode_ordinary(c) and bpe.decode(bpe.encode(c)) == c.encode()
        assert all(bpe.bytes_of[i] == c.encode()[a:b] and c.encode()[a:b] in c[p:q].encode() for i, (a, b), (p, q) in zip(one, spans, chars, strict=True))
    got = collections.Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in byte_bpe.digests(docs, RANKS, PATTERN).collect())
    want = collections.Counter()
    for i, t in awkward():
        e = truth.encode_ordinary(t or "")
        want[i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    back = byte_bpe.decoded(byte_bpe.encoded(docs, JSON, PATTERN), JSON, PATTERN)
    assert collections.Counter((x.doc_id, bytes(x.bytes)) for x in back.collect()) == collections.Counter((i, (t or "").encode()) for i, t in awkward())
    assert byte_bpe.digests(nothing, RANKS, PATTERN).count() == 0


# ---- SimHash


def slow_fingerprint(text, k=4):
    w = words_of(text)
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints: dict, radius=4):
    left, out = dict(prints), {}
    while left:
        start = left.popitem()
        group, work = [start], [start]
        while work:
            _, a = work.pop()
            near = [(i, b) for i, b in left.items() if bin(a ^ b).count("1") <= radius]
            for i, b in near:
                del left[i]
            group += near
            work += near
        least = min(i for i, _ in group)
        out |= {i: least for i, _ in group}
    return out


def test_anchors_of_more_words_than_place_bits(monkeypatch):
    monkeypatch.setattr(substrings, "_ROW", np.uint64(255))
    a = substrings.Anchors([(prose(3, 900) + " " + prose(4, 50) * 4).encode(), prose(3, 400).encode()])
    n, width = len(a.words), a.window - a.seed + 1
    assert n > 1200
    want = [min(range(w, min(w + width, n)), key=lambda j: (int(a.seeds[j]) >> 8, j)) for w in a.windows.tolist()]
    assert a.anchor.tolist() == want


def test_simhash_groups(spark, docs, nothing):
    rows = [(i, t) for i, t in awkward() if i is not None]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_groups(prints)
    assert simhash.near_duplicates(docs).count() == len(awkward()) and simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(slow_groups(prints).values()))


@pytest.mark.parametrize(("bucket", "most"), [(2, 5), (7, 6), (2048, 6), (2048, 8), (7, 5)])
def test_simhash_links_across_hot_buckets(spark, monkeypatch, bucket, most):
    monkeypatch.setattr(simhash, "MOST", ((1 << 40, most),))
    r = random.Random(5)
    values = [r.getrandbits(64) for _ in range(60)]
    for centre in (0, 0xFFFF0000FFFF0000):
        values += [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(60)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.similar(spark.createDataFrame([(v,) for v in signed], "bits bigint"), bucket=bucket)
    roots, _ = simhash.components(links)
    found = {x.node: x.root for x in roots.collect()}
    want = slow_groups(dict(zip(signed, values, strict=True)))
    parts = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert parts({s: found.get(s, s) for s in signed}) == parts(want)


def test_bit_sliced_distances():
    r = np.random.default_rng(0)
    values = r.integers(0, 2**63, 999, dtype=np.uint64)
    for i in range(1, 999):
        if i % 3:
            values[i] = values[i - 1]
            for bit in r.choice(64, r.integers(0, 8), replace=False):
                values[i] ^= np.uint64(1) << np.uint64(bit)
    planes = simhash.planes_of(values)
    for radius in (0, 1, 3, 4, 7):
        for by in (1, 2, 63, 64, 65, 128, 700, 998):
            asked = np.arange(999) + by < 999
            asked &= r.random(999) < 0.9
            want = [i for i in np.flatnonzero(asked).tolist() if int(values[i] ^ values[i + by]).bit_count() <= radius]
            assert simhash.places(simhash.near_places(planes, by, simhash.mask_of(asked), radius), 999).tolist() == want


@pytest.mark.parametrize("count", [10, 1 << 20, 1 << 30, 1 << 40])
def test_keys_miss_no_pair_and_grow(count):
    ranges = simhash.ranges_of(count)
    assert sum(w for _, w in ranges) == 64 and len(ranges) - 4 >= 1
    r = random.Random(count)
    for _ in range(200):
        flips = {r.randrange(64) for _ in range(4)}
        clean = [i for i, (a, w) in enumerate(ranges) if not any(a <= f < a + w for f in flips)]
        assert len(clean) >= len(ranges) - 4


def test_keys_of_a_fingerprint_do_not_jump_as_the_corpus_grows():
    assert {len(simhash.ranges_of(n)) for n in (1, 1 << 14, (1 << 14) + 1, 97_312, 1 << 26)} == {6}


# ---- HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, None), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>x<th>long<tr><td>wide cell<td>2</table>z", "x          long\nwide cell  2\n\nz"), ("<table><td>a<td>b</table>", "a  b"),
        ("<script>x<p></script><style>y</style>k<noscript>n</noscript>", "k"), ("<p hidden>a</p><p style='display: none'>b</p><p style='visibility:hidden'>c</p>d", "d"),
        ("<pre> a\n  b</pre>", " a\n  b"), ("a &amp; b &lt;c&gt; &copy;", "a & b <c> \u00a9"), ("3 < 4 <b>bold</b> <3", "3 < 4 bold <3"), ("<b><p>x</b>y", "xy"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"), ("<table>stray<tr><td>c</table>", "stray\n\nc"), ("<details><summary>s</summary>no</details>", "s"), ("<!-- x --><!doctype html>y", "y"),
        ("a\u00a0\u00a0b   c", "a\u00a0\u00a0b c"), ("<title>t</title><body>b", "b"), ("<img alt='pic'> p", "pic p"),
    ],
)
def test_layout(html, text):
    assert layout.page_text(html) == text


@pytest.mark.parametrize(
    ("html", "words"),
    [
        ("<table><p>Hello</p><tr><td>x</table>", ["Hello", "x"]),
        ("<table><p>Hello<tr><td>x</table>", ["Hello", "x"]),
        ("<table><p>one<table><p>two<table>three<tr><td>x", ["one", "two", "three", "x"]),
        ("<table><tr><h2>Title</h2><td>x</table>", ["Title", "x"]),
        ("<table><tbody><li>one<li>two<tr><td>x</table>", ["-", "one", "-", "two", "x"]),
        ("<table><dt>a<dd>b<tr><td>x<td>y</table>", ["a", "b", "x", "y"]),
        ("<p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math>", ["sum", "x+1"]),
        ("<svg><title>no</title><text>one</text><text>two</text></svg>", ["one", "two"]),
        ("<select><option>red<option>blue</select>", ["red", "blue"]),
    ],
)
def test_layout_keeps_visible_text(html, words):
    assert layout.page_text(html).split() == words


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p title=it's>Hello world, don't <b>go</b> away", "Hello world, don't go away"), ("a</ x>b", "ab"), ("<table><form><tr><td>a<td>b</form></table>", "a  b"),
        ("<table><tfoot><tr><td>foot<tbody><tr><td>body<thead><tr><td>head</table>", "head\nbody\nfoot"), ("<style>.h{display:none} p.v{visibility:hidden}</style><p class='x h'>no<p class=v>no<b style=visibility:visible>yes</b>", "yes"),
        ("<style>@media print{p{display:none}} #i{display:none!important}</style><p>a<p id=i>no", "a"), ("<style>/* {} */ div{display:none} .s{display:block}</style><div>no</div><div class=s>yes</div>", "yes"),
        ("<p hidden style='display:block'>shown", "shown"), ("<input type=submit value=Send><input type=hidden value=no><input value=typed><input type=password value=no>", "Send typed".replace(" ", "")),
        ("<head><meta charset=x>visible", "visible"), ("<pre>\n\na</pre>", "\na"), ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\nin  ner"), ("x <a href='>'>y</a> z", "x y z"),
        ("<p>a<b unfinished", "a"), ("<textarea><p>kept</textarea>", "<p>kept"), ("<table><tr><td colspan=2>ab<tr><td>c<td>d</table>", "ab\nc  d"), ("a<wbr>b<q>c</q>", "abc"),
    ],
)
def test_layout_as_browsers_have_it(html, text):
    assert layout.page_text(html).strip("\n") == text.strip("\n")


def random_page(r, words, depth=0):
    """A page and the visible words in it, by construction: every text is a new word, and hidden ones begin with an h."""
    out = []
    for _ in range(r.randint(1, 5)):
        kind = r.random()
        if kind < 0.35 or depth > 6:
            words.append(f"w{len(words)}")
            out.append(r.choice([" ", "\n", "&#32;"]) + words[-1] + r.choice([" ", " <br> "]))
        elif kind < 0.45:
            inner = f"h{r.random()}"
            out.append(r.choice([f"<script>{inner}</script>", f"<p hidden>{inner}</p>", f"<div style='display:none'>{inner}<b>{inner}</b></div>", f"<style>{inner}</style>", f"<!-- {inner} -->", f"<i style=visibility:hidden>{inner}</i>", f"<details>{inner}</details>"]))
        elif kind < 0.6:
            rows = "".join("<tr>" + "".join(f"<td{r.choice(['', ' colspan=2', ' rowspan=2'])}>{random_page(r, words, depth + 2)}" for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3)))
            stray = random_page(r, words, depth + 3) if r.random() < 0.3 else ""
            out.append(f"<table>{stray}{rows}</table>")
        elif kind < 0.7:
            out.append("<ul>" + "".join(f"<li>{random_page(r, words, depth + 2)}" for _ in range(r.randint(1, 3))) + "</ul>")
        else:
            name = r.choice("p div span b h2 section a pre blockquote dl em form select".split())
            out.append(f"<{name}{r.choice(['', ' class=c', ' title=it' + chr(39) + 's', ' x=' + chr(34) + '>' + chr(34)])}>{random_page(r, words, depth + 1)}" + r.choice([f"</{name}>", f"</{name} >"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_layout_loses_no_visible_text(seed):
    words: list[str] = []
    page = random_page(random.Random(seed), words, 2)
    found = [w for w in layout.page_text(page).split() if w != "-"]
    assert sorted(found) == sorted(words), page


@pytest.mark.parametrize("part", ["<a '", '<a b="', "</x", "<td colspan=1000>x", "<!--", "<p", "<", "<style>@media{a{b:c}", "&", "<table><p>x", "<style>.a{display:none}</style><p class=a>"])
def test_layout_takes_time_in_proportion(part):
    import time

    began = time.process_time()
    layout.page_text(part * (200_000 // len(part)))
    assert time.process_time() - began < 10


def test_layout_of_tables_and_depth(spark):
    pages = spark.createDataFrame([(1, "<p>a", 3), (1, "<p>a", 3), (None, None, 4), (2, "<div>" * 5000 + "deep" + "<table><tr><td>" * 100 + "x", 5)], "page_id bigint, html string, text int")
    assert sorted((r.page_id or 0, (r.text or "-")[:4]) for r in layout.extracted(pages).collect()) == [(0, "-"), (1, "a"), (1, "a"), (2, "deep")]
    assert layout.extracted(pages.limit(0)).count() == 0


# ---- substring dedup


def slow_cover(texts: list[bytes], window: int):
    lists = [t.split() for t in texts]
    counts = collections.Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(([x for x, g in zip(w, gone, strict=True) if not g], sum(gone)))
    return out


@pytest.mark.parametrize(("window", "seed"), [(35, 8), (6, 3), (3, 1), (5, 5)])
def test_substrings(spark, docs, nothing, window, seed):
    r = random.Random(window)
    extra = [(1000 + i, " ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.randint(0, 40)))) for i in range(40)]
    df = docs.unionByName(documents(spark, extra))
    rows = awkward() + extra
    want = collections.Counter((i, len((t or "").encode().split()), gone, hashlib.sha256(b" ".join(kept)).hexdigest()) for (i, t), (kept, gone) in zip(rows, slow_cover([(t or "").encode() for _, t in rows], window), strict=True))
    covered = substrings.repeats(df, window=window, seed=seed)
    assert collections.Counter((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.digests(covered).collect()) == want
    left = substrings.deduplicated(df, length_col="n_chars", window=window, seed=seed)
    assert left.columns == df.columns
    assert collections.Counter((x.doc_id, tuple(x.text.encode().split())) for x in left.collect()) == collections.Counter((i, tuple(kept)) for (i, _), (kept, _) in zip(rows, slow_cover([(t or "").encode() for _, t in rows], window), strict=True))
    assert all(x.n_chars == len(x.text) and x.tag == 1 and x._text == "clash" for x in left.collect())
    assert substrings.repeats(nothing).count() == 0


# ---- nearest neighbours


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[500:560] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000, None, 0), (2020, [], 0), (2040, [0.0] * 16, 0), (2060, [float("nan")] * 16, 0), (2080, [None] + [1.0] * 15, 0), (2100, [float("inf")] * 16, 0), (2120, [1.0] * 8, 0), (None, x[0].tolist(), 0), (20, x[20].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int")
    got = collections.defaultdict(list)
    for row in stable_knn.nearest(df, 20, 20, part=300, block=16).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    assert set(got) == set(range(0, 900, 20))
    found = total = 0
    for q, rows in got.items():
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        truth = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]
        assert [k for k, *_ in rows] == list(range(1, 21)) and all(i != q for _, i, _ in rows)
        assert np.allclose([s for *_, s in rows], [scores[i] for _, i, _ in rows], atol=1e-12)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        found += len({i for _, i, _ in rows} & {i for _, i in truth})
        total += 20
    assert found / total >= 0.9
    assert stable_knn.nearest(df.limit(0), 20, 20).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in stable_knn.nearest(few, 20, 20).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]


def test_chi_square():
    assert abs(stable_knn.chi_square_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(stable_knn.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


# ---- packing


def test_packing(spark, docs, nothing):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want = collections.Counter()
    for i, t in awkward():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        for p, (a, n) in enumerate(packing.cuts(len(ids), 1024)):
            want[i, p, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, JSON, PATTERN).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == slow_best_fit([n for *_, n, _ in want.elements()], 1024)
    assert packing.pack_documents(nothing, JSON, PATTERN).count() == 0


def slow_best_fit(sizes, capacity):
    """Best-fit decreasing, one document at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_best_fit(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, r.choice([10, 50, 100])) for _ in range(r.randint(1, 400))]
    runs = packing.best_fit(dict(collections.Counter(sizes)), 100)
    assert sum(b - a for _, a, b, *_ in runs) == len(sizes)
    used = {first + i for _, a, b, first, _ in runs for i in range(b - a)}
    assert len(used) == slow_best_fit(sizes, 100)


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(4, 4) == [(0, 4)] and packing.cuts(1, 4) == [(0, 1)]
