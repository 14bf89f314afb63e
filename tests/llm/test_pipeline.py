from __future__ import annotations

import collections
import os
import random

import corpus_pipeline

from attestra.llm import language, near, packing
from attestra.llm.common import drop

from .helpers import documents, prose
from .test_operators import JSON, PATTERN, slow_cover, slow_fingerprint, slow_groups


def corpus():
    passage = prose(50, 70)
    rows = [(i, f"{prose(i, 120)} {passage if i % 5 == 0 else ''} {prose(1000 + i, 90)}") for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200, rows[7][1] + " end"), (201, "12 34 !!"), (202, None)]
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = corpus()
    df = documents(spark, rows, ["en"] * 20 + ["de"] * (len(rows) - 20)).select(*corpus_pipeline.COLUMNS)
    docs, sizes = df, [df.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        sizes.append(docs.count())
    training = language.samples(df)
    classify = language.Classifier(training)
    clear = [(i, t) for i, t in rows if classify(t)[1] >= language.REJECT]
    assert sizes[1] == len(clear) and {201, 202} & {i for i, _ in clear} == set()
    tops = set(slow_groups({i: slow_fingerprint(t) for i, t in clear}).values())
    kept = sorted((i, t) for i, t in clear if i in tops)
    assert sizes[2] == len(kept) < len(clear)
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "substring_dedup")).collect()}
    left = slow_cover([t.encode() for _, t in kept], 35)
    assert {i: t.encode().split() for i, t in texts.items()} == {i: w for (i, _), (w, _) in zip(kept, left, strict=True)}
    assert any(gone for _, gone in left)
    packed = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect())
    again = packing.pack_documents(documents(spark, sorted(texts.items())), JSON, PATTERN)
    assert packed == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in again.collect())


def test_near_dedup_reaches_likeness(spark):
    def edited(words, n):
        return " ".join(f"new{i}" if i % (len(words) // n) == 7 and i // (len(words) // n) < n else w for i, w in enumerate(words))

    def likeness(x, y):
        a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y))
        return len(a & b) / len(a | b)

    rows = []
    for i in range(12):
        text = prose(i, 300)
        rows += [(10 * i, text), (10 * i + 1, edited(text.split(), 1 + i // 2)), (10 * i + 2, edited(text.split(), 20))]
    rows += [(500 + i, edited(prose(77, 300).split(), 1).replace("new7", f"only{i}")) for i in range(60)] + [(900, "two words"), (901, "two words"), (902, "Two  words")]
    assert all(likeness(rows[3 * i][1], rows[3 * i + 1][1]) >= 0.8 > likeness(rows[3 * i][1], rows[3 * i + 2][1]) for i in range(12))
    docs = documents(spark, rows).select(*corpus_pipeline.COLUMNS).repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {10 * i for i in range(12)} | {10 * i + 2 for i in range(12)} | {500, 900}


def groups_of(rows, k=5, percent=80):
    """The ids that stay by all pairs: the least of each group of texts with words, and every text without."""
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids, up = sorted(sets), {}

    def root(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i for i in ids if root(i) == i}


def test_near_dedup_keeps_whole_groups(spark):
    """Chains whose ends are not alike: only the first of each stays, whatever the hashes; and no clean document goes."""

    def changed(text, seed, n):
        words, r = text.split(), random.Random(seed)
        for at in r.sample(range(len(words)), n):
            words[at] = f"new{r.randrange(10**6)}"
        return " ".join(words)

    rows = []
    for g in range(25):
        a = prose(300 + g, 300)
        b = changed(a, g, 5)
        c = changed(b, 1000 + g, 5)
        rows += [(100 * g + 7, a), (100 * g + 3, b), (100 * g + 9, c), (100 * g + 11, changed(c, 2000 + g, 5))]
    text = prose(77, 200)
    rows += [(5000 + i, changed(text, 3000 + i, 1 + i % 5)) for i in range(50)] + [(9000 + i, prose(4000 + i, 80)) for i in range(20)] + [(9900, "two words"), (9901, "Two  words"), (9902, "two wordz")]
    want = groups_of(rows)
    sizes = len(rows) - len(want)
    assert 60 < sizes and {9902, 9900} <= want and 9901 not in want
    clash = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows] + [(None, text, "x", 1, 2), (9000, prose(4000, 80), "y", 3, 4), (9950, "", None, 1, 2), (9951, None, None, 1, 2)], "doc_id long, text string, label string, c int, key int").repartition(5)
    kept = near.one_of_each(clash).collect()
    assert collections.Counter(r.doc_id for r in kept) == collections.Counter([*want, None, 9950, 9951]) and set(kept[0].asDict()) == {"doc_id", "text", "label", "c", "key"}


def test_run_and_empty_table(spark, tmp_path):
    df = documents(spark, corpus(), ["en"] * len(corpus())).select(*corpus_pipeline.COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    os.makedirs(tmp_path / "none")
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_dropped_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    drop(spark, path)
    assert not os.path.exists(path)
