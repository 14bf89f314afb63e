"""Whitening, centroid clustering and the Jaccard join against plain definitions."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from attestra.llm import centroids, jaccard, queries, trees, whitening

from .helpers import awkward, documents, prose

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def vectors(spark, rows):
    """(vec_id, embedding) with columns whose names the operators use themselves."""
    rows = [(i, v, "c", 1.5, "n") for i, v in rows]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cluster string, _x double, n string").repartition(3)


def gaussian(n: int, width: int, seed: int = 0, spread=None) -> list[list[float]]:
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, width)) * (spread if spread is not None else 1)).astype(np.float32).tolist()


BAD = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [None] + [0.0] * 63)]


# ---- whitening


def plain_whitening(rows, k=4):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = {}
    for at, (_, v) in enumerate(kept):
        x[at] = tuple([math.floor(256 * c) for c in v] + [0] * (width - len(v)))
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    e, vec = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:k]
    out = []
    for at, (i, _) in enumerate(kept):
        deviation = sum((n * c - s) ** 2 for c, s in zip(x[at], sums, strict=True))
        centred = np.array([(n * c - s) / n for c, s in zip(x[at], sums, strict=True)])
        for j, o in enumerate(order):
            out.append((i, j + 1, n, deviation, float(centred @ vec[:, o]) / math.sqrt(max(e[o], 1e-300)), e[o] / e.sum()))
    return out


def held_whitening(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = sorted(([r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained] for r in got), key=key)
    want = sorted(want, key=key)
    sign = {}
    for g, w in zip(got, want, strict=True):
        assert g[:4] == list(w[:4]) and math.isclose(g[5], w[5], rel_tol=1e-6)
        if abs(w[4]) > 1e-6:
            sign.setdefault(g[1], 1 if g[4] * w[4] > 0 else -1)
            assert math.isclose(g[4] * sign[g[1]], w[4], rel_tol=1e-6, abs_tol=1e-8)


def test_whitening(spark):
    spread = np.linspace(3, 0.2, 12)
    rows = list(enumerate(gaussian(150, 12, 1, spread)))
    rows += [(200 + i, rows[3][1]) for i in range(80)] + [(3, rows[3][1]), (None, rows[4][1]), (300, [0.5, 0.25]), (301, [])] + [b for b in BAD if b[0] != 901 and (b[1] is None or len(b[1]) <= 2)]
    rows += [(310, [float("nan")] * 12), (311, [float("-inf")] + [0.0] * 11), (312, [0.004] * 12), (313, [0.0041] * 12)]
    got = whitening.whitened(vectors(spark, rows)).collect()
    held_whitening(got, plain_whitening(rows))
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_of_little(spark):
    assert whitening.whitened(vectors(spark, [(1, None)])).count() == 0 and whitening.whitened(vectors(spark, [(1, [])])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0
    same = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, 0.0)] * 4
    line = whitening.whitened(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)} and {r.component for r in line} == {1, 2, 3}
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(vectors(spark, [(1, [3e38])])).count()


def test_whitening_keeps_small_spread_about_a_large_centre():
    """A covariance by sums of squares would lose this; n*x - S in integers does not, in Python's where 64 bits end."""
    r = np.random.default_rng(5)
    x = (1 << 40) + r.integers(-300, 300, (500, 3))
    centred = whitening.Centred(500, [sum(c) for c in x.T.tolist()])
    mean = [sum(c) / 500 for c in (x - (1 << 40)).T.tolist()]
    assert np.allclose(centred.doubles(x), (x - (1 << 40)) - np.array(mean), atol=1e-9)
    assert centred.deviations(x[:3]) == [sum((500 * c - s) ** 2 for c, s in zip(v, centred.sums, strict=True)) for v in x[:3].tolist()]
    assert centred.deviations(np.array([[1 << 50, 0, 0]])) == [None]


def test_tree_merges_all_parts(spark):
    parts = spark.createDataFrame([(p, s, bytes([p % 251]) * (s + 1)) for p in range(70) for s in range(2)], "part bigint, segment int, payload binary")
    got = trees.merged(parts, lambda x: b"".join(x), "test", 4)
    assert {s: collections.Counter(v) for s, v in got.items()} == {s: collections.Counter({p: s + 1 for p in range(70)}) for s in range(2)}
    assert trees.merged(parts.limit(0), lambda x: b"".join(x), "test") == {}
    wide = np.full((3, 2), 1 << 61, np.int64)
    assert trees.column_sums(wide) == [3 << 61] * 2


@tables
def test_op11(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet'").fetchall()
    held_whitening(queries.op11_whitening(spark, DIR).collect(), plain_whitening(rows))


# ---- centroid clustering


def plain_clusters(rows, k=40, rounds=5, length=64):
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return collections.Counter()
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(x) for _, x in order[:k]]
    x = np.array([v for _, v in kept], np.int64).reshape(-1, length)

    def nearest():
        d = np.stack([((x - np.array(c, np.int64)) ** 2).sum(1) for c in centres], axis=1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        own, _ = nearest()
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = [sum(col) // int((own == c).sum()) for col in x[own == c].T.tolist()]
    own, d = nearest()
    inertia = {c: int(d[own == c].sum()) for c in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((i, int(c), int(e), inertia[int(c)], int(d.sum()), digest[int(c)]) for (i, _), c, e in zip(kept, own, d, strict=True))


def found_clusters(df):
    return collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters(spark):
    groups = gaussian(25, 64, 2, 4.0)
    rows = [(i, (np.array(groups[i % 25], np.float32) + np.array(v, np.float32)).tolist()) for i, v in enumerate(gaussian(400, 64, 3))]
    rows += [(1000 + i, rows[0][1]) for i in range(120)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[5][1])] + BAD
    scans = []
    got = found_clusters(centroids.clustered(vectors(spark, rows), scans=scans))
    assert got == plain_clusters(rows)
    assert scans[0] == sum(got.values()) and sum(scans[1:]) < 0.9 * scans[0] * (len(scans) - 1)


def test_clusters_of_little(spark):
    for rows in ([], BAD, [(1, [0.125] * 64)], [(i, [0.5] * 64) for i in range(60)], [(i, [float(i % 2)] * 64) for i in range(90)]):
        assert found_clusters(centroids.clustered(vectors(spark, rows) if rows else vectors(spark, BAD).limit(0))) == plain_clusters(rows)
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(vectors(spark, [(1, [1e6] * 64)])).count()


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_change_a_cluster(seed):
    """Random moves of few, many, equal and far centroids: clusters equal full scans, ties by number, in every round."""
    r = np.random.default_rng(seed)
    size = [3, 300, 5 << 20, (1 << 26)][seed % 4]
    x = r.integers(-size, size, (300, 5))
    centres, before = r.integers(-size, size, (1 + 7 * (seed % 2), 5)), None
    cluster, upper, lower = np.zeros(300, np.int32), np.zeros(300), np.zeros(300)
    for nth in range(8):
        cluster, upper, lower, _ = centroids.Step(centres, before)(x, cluster, upper, lower)
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        assert (upper**2 >= d.min(1)).all()
        before, centres = centres, centres + r.integers(-1 - size // 40, 2 + size // 40, centres.shape) * (r.random((len(centres), 1)) < 0.5)
        if nth == 4:
            centres[-1] = centres[0]


@tables
def test_op13(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet'").fetchall()
    assert found_clusters(queries.op13_centroids(spark, DIR)) == plain_clusters(rows)


# ---- Jaccard join


def plain_sets(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_join(rows, percent=80):
    """(id, size, component) of every row, by all pairs."""
    sets = [plain_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    members = collections.defaultdict(list)
    for i, (name, _) in enumerate(rows):
        members[root(i)].append(name)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return collections.Counter((name, len(sets[i]), least[root(i)]) for i, (name, _) in enumerate(rows))


def found_join(df):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def test_join_of_awkward_texts(spark):
    rows = [*awkward(), (30, "a b c d"), (31, "A  B c\td"), (32, "a b c d e"), (33, ""), (None, ""), (None, prose(7, 50) + " end"), (40, "Ä b"), (41, "ä b"), (2, prose(2, 200))]
    assert found_join(jaccard.joined(documents(spark, rows).repartition(3))) == plain_join(rows)
    assert jaccard.joined(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [3, 1024])
def test_join_of_near_copies(spark, bucket):
    """Groups whose likeness is all about the threshold, one large, and shared boilerplate: links that only one path of a chain makes are found."""
    boiler = prose(900, 40, 60)
    rows = [(i, prose(i, 30 + 7 * i)) for i in range(20)]
    for g in range(12):
        text = prose(100 + g, 120 + 10 * g)
        rows += [(1000 + 100 * g + i, edited(text, 31 * g + i, 0.012)) for i in range(8)]
    text = prose(500, 150)
    rows += [(5000 + i, edited(text, 900 + i, 0.018)) for i in range(60)]
    rows += [(7000 + i, boiler + " " + prose(2000 + i, 12)) for i in range(30)]
    rows += [(8000 + i, " ".join(prose(3000, 60).split()[: 30 + i])) for i in range(30)]
    random.Random(1).shuffle(rows)
    want = plain_join(rows)
    sizes = collections.Counter(c for _, _, c in want.elements())
    assert len(sizes) > 40 and max(sizes.values()) > 20
    for few in (10**9, 1, 0):
        assert found_join(jaccard.joined(documents(spark, rows).repartition(4), few=few, bucket=bucket)) == want


def test_filters_lose_no_pair():
    """Prefixes of pairs that link share an element, and no bound is below the true intersection."""
    r = random.Random(3)
    for _ in range(400):
        universe = sorted({r.getrandbits(64) for _ in range(r.choice([8, 60, 400]))})
        a = {x for x in universe if r.random() < r.choice([0.5, 0.9, 0.97])} or {1}
        b = {x for x in a if r.random() < 0.95} | {x for x in universe if r.random() < 0.04} or {1}
        rank = {x: (r.randrange(4), x) for x in a | b}
        one, two = (np.array(sorted(s, key=rank.get), np.uint64) for s in (a, b))
        p, q = one[: jaccard.prefix_length(len(a))], two[: jaccard.prefix_length(len(b))]
        both = len(a & b)
        if 100 * both >= 80 * len(a | b):
            assert both >= jaccard.overlap(len(a) + len(b)) and set(p.tolist()) & set(q.tolist())
            first = min(set(p.tolist()) & set(q.tolist()), key=rank.get)
            i, j = p.tolist().index(first), q.tolist().index(first)
            assert min(len(a) - i, len(b) - j) >= jaccard.overlap(len(a) + len(b))
            assert jaccard.suffix_bound(p, q, jaccard.ranges_of(one), jaccard.ranges_of(two), i, j) >= both


@tables
def test_op12(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    assert found_join(queries.op12_jaccard_join(spark, DIR)) == plain_join(rows)
