"""Forms, heading windows, candidate texts and feature graphs against plain Python."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from attestra.functions.evidence import heading_share
from attestra.functions.similarity import partial_ratio, partial_ratios
from attestra.operators import candidates, evaluation, graphs, headings
from attestra.plans import panels
from attestra.sources import forms

FORM = """<!DOCTYPE html>
<html><!-- a comment --><body><form>
<table><tr><td><div class="label">1. REP. ID. NO. (If any)</div><div class="data"> 77 &amp; 78 </div></td>
<td><div class="boldlabel">6. BRAND&nbsp;NAME</div><div class="label">BRAND NAME (Required)</div><div class="data">OAK<br>HOLLOW</div><div class="data">OAK
HOLLOW</div><div class="databold">No. 2</div></td></tr>
<tr><td><div class="label">2. PLANT REGISTRY/BASIC PERMIT</div><div class="data"></div></td><td><div class=label>3a. <b>BASIC PERMIT</b></div><div class=data>late</div></td></tr>
<tr><td><input type=checkbox checked alt="Source of Product: Imported"><input type=checkbox alt="Type of Product: Wine"><INPUT type=checkbox CHECKED ALT="type of product:  Malt : Beverages"/></td></tr>
<tr><td><input type=checkbox checked alt="the Type of Application"> CERTIFICATE
 OF  APPROVAL<tr><td>inner</td></tr></td></tr></table>
<div class="label">DATE ISSUED</div><div class="data">01/02/2024</div><div class="label">WINE VINTAGE</div><p>no data</p>
<div class="boldlabel">STATUS HISTORY</div><p>x</p><div class="plain">none</div>
<div class="boldlabel">STATUS</div><div class="data">The status is  expired.</div>
<img src="seal.gif"> Affix nothing. AFFIX COMPLETE SET OF LABELS BELOW <p>image type: Neck &amp; Strip</p>
<span>actual dimensions: 1.25 inches w x 0.5 inches h</span><img SRC='publicViewAttachment.do?filetype=l&filename=a%20b%2.jpg' alt=' Neck  one '>
<p>Image Type</p><p>Actual Dimensions: none</p><img src="http://other.example.org/publicViewAttachment.do?filename=c.jpg&filetype=l" width=5>
<img src="/publicViewAttachment.do?filename=small.jpg&filetype=s"><img src="publicViewSignature.do"></form></div></body></html>"""


def test_form(spark):
    pages = spark.createDataFrame([(1, FORM, "https://r.example.org/a/b.do?x=1#y", "kept"), (2, None, None, None), (3, "", "u", "k"), (4, "<div class=label>TTB ID<div class=data>5</div>", "u", "k")], "id int, html string, url string, text string")
    got = {r.id: r for r in forms.applications(forms.form_fields(pages, "html", "url")).collect()}
    r = got[1]
    assert (r.text, r.representative_id, r.brand_name, r.plant_registry_basic_permit_brewers_number) == ("kept", "77 & 78", "OAK\nHOLLOW\nNo. 2", "")
    assert (r.source_of_product, r.type_of_product, r.application.product_type, r.application.imported) == ("Imported", "Malt : Beverages", "malt_beverage", True)
    assert r.type_of_application.split() == "CERTIFICATE OF APPROVAL inner".split()
    assert (r.date_issued, r.status, r.qualifications, r.ttb_id, r.special_wording) == ("01/02/2024", "expired", "", "", "")
    # Without a cell or data beside it, a label takes all data of what it stands in.
    assert r.wine_vintage.startswith("77 & 78\nOAK\nHOLLOW")
    a, b = r.attachments
    assert (a.panel_order, a.filename, a.source_url, a.image_type, a.width_inches, a.height_inches, a.alt_text) == (1, "a b%2.jpg", "https://r.example.org/a/publicViewAttachment.do?filetype=l&filename=a%20b%2.jpg", "Neck & Strip", 1.25, 0.5, "Neck one")
    assert (b.panel_order, b.filename, b.image_type, b.width_inches, b.html_width, b.html_height) == (2, "c.jpg", "", None, "5", None)
    for i in (2, 3):
        assert got[i].brand_name == "" and got[i].attachments == [] and got[i].application.filename == ".jpg"
    assert got[4].ttb_id == "5"
    assert forms.form_fields(pages.limit(0), "html", "url").count() == 0


def test_elements_nest_as_written():
    rows = forms.elements_of("<p>a<br>b<p>c</div></p>d<script>x<y</script></p><td><tr><td>e")
    tree = [(r["name"], r["parent"], r["last"], r["cell"], r["row"]) for r in rows]
    assert tree[:3] == [("p", -1, 8, -1, -1), (None, 0, 1, -1, -1), ("br", 0, 2, -1, -1)]
    assert [r["text"] for r in rows if r["name"] is None and r["shown"]] == ["a", "b", "c", "d", "e"]
    assert [r["text"] for r in rows if r["name"] is None and not r["shown"]] == ["x<y"]
    td, tr, inner, e = tree[-4:]
    assert (td[0], tr[0], inner[0]) == ("td", "tr", "td") and tr[3] == len(rows) - 4 and e[3:] == (len(rows) - 2, len(rows) - 3) and inner[4] == len(rows) - 3


def test_links_and_addresses(spark):
    html = '<p>x</p><a href="../up?q=1">one <b>two</b></a> mid<a name="no">none</a><a href="#z"></a><a href="?k">q</a><a href="//h.example/p">h</a><a href="mailto:a@b">m</a>'
    got = forms.links(spark.createDataFrame([(1, html, "http://h.example.com/d/e?f"), (2, None, "u")], "id int, html string, url string"), "id", "html", "url").collect()
    assert [(r.place, r.leads_to, r.says, r.before) for r in got] == [
        (1, "http://h.example.com/d/../up?q=1", "one two", "x"), (2, "http://h.example.com/d/e?f#z", "", "none"), (3, "http://h.example.com/d/e?k", "q", None),
        (4, "http://h.example/p", "h", "q"), (5, "mailto:a@b", "m", "h"),
    ]


# ---- headings


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_heading(blocks):
    def score(s):
        s = "".join(c for c in s.upper() if c.isalpha())
        if headings.HEADING in s:
            return 1.0
        return 0.95 if all(w in s for w in headings.WORDS) else lcs(s[:25], headings.HEADING) / 17

    best = None
    n = len(blocks)
    for a, w in [(i, 1) for i in range(n)] + [(i, w) for i in range(n) for w in range(2, 8) if i + w <= n]:
        part = blocks[a : a + w]
        pts = [p for b in part for p in b[2] or [] if len(p) >= 2]
        if any(b[2] is None for b in part) or not pts:
            continue
        s, known = score(" ".join(b[0] or "" for b in part)), [b[1] for b in part if b[1] is not None]
        sure = sum(known) / len(known) if known else None
        if s >= 0.72 and (best is None or (s, sure or 0.0) > (best[1], best[2] or 0.0)):
            x, y = [p[0] for p in pts], [p[1] for p in pts]
            best = (" ".join(b[0] or "" for b in part).strip(), s, sure, [[min(x), min(y)], [max(x), min(y)], [max(x), max(y)], [min(x), max(y)]], a, w)
    return best


def test_best_heading(spark):
    r = random.Random(2)
    stock = ["GOVERNMENT", "WARNING:", "Government", "Warning", "GOVERMENT", "WARNlNG", "GOV", "ERNMENT", "(1)", "según", "", None, "GOVERNMENT WARNING: drink", "wine", "GOVERN", "MENT WARN", "ING", "ẞtraße"]
    rows = [(0, []), (1, None), (2, [("GOVERNMENT", 0.5, [[0.1, 0.62], [0.31, 0.66]]), ("WARNING:", 0.75, [[0.33, 0.62], [0.52, 0.66]])]), (3, [("GOVERNMENT WARNING", 0.5, None)]), (4, [("GOVERNMENT WARNING", None, [[1.0]])])]
    for i in range(5, 150):
        rows.append((i, [(r.choice(stock), r.choice([None, 0.25, 0.5, 0.75]), r.choice([None, [], [[r.randrange(9) / 8, 0.5], [r.randrange(9) / 8, 0.75]], [[1.0, 2.0], [0.5]]]) if r.random() < 0.3 else [[r.randrange(9) / 8, 0.25], [1.0, 0.5]]) for _ in range(r.randrange(12))]))
    df = spark.createDataFrame(rows, "id int, blocks array<struct<text:string,confidence:double,bbox:array<array<double>>>>")
    got = {x.id: x.h for x in df.select("id", headings.best_heading(F.col("blocks")).alias("h")).collect()}
    some = 0
    for i, blocks in rows:
        want = plain_heading(blocks or [])
        have = None if got[i] is None else (got[i].text, got[i].score, got[i].confidence, got[i].bbox, got[i].first, got[i].width)
        if want is None:
            assert have is None
        else:
            some += 1
            assert have[0] == want[0] and math.isclose(have[1], want[1]) and have[2:] == want[2:], (blocks, have, want)
    assert some > 60 and got[2].text == "GOVERNMENT WARNING:" and got[2].score == 1.0


def test_crop_and_bounds(spark):
    rows = [([[0.1, 0.2], [0.5, 0.3]], "GOVERNMENT WARNING: and more", 1000, 500), ([[100.0, 50.0], [300.0, 80.0]], "GOVERNMENT WARNING", 1000, 500), (None, "x", 100, 50)]
    df = spark.createDataFrame(rows, "box array<array<double>>, line string, w int, h int")
    got = [tuple(r.c) for r in df.select(headings.crop(F.col("box"), F.col("line"), heading_share(F.col("line")), F.col("w"), F.col("h")).alias("c")).collect()]
    share = 19 / 28
    assert got[0] == (85, 90, round(100 + 400 * share * 1.08 + 15), 152)
    assert got[1] == (91, 44, 309, 82) and got[2][:2] == (0, 0) and got[2][3] == 50


def test_lines_above_an_image_are_taken_once(spark):
    df = forms.with_elements(spark.createDataFrame([("<p>x</p>",)], "html string"), "html").select(forms.attachments(F.col("elements"), F.lit("http://a.b/c")).alias("a"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(forms.FIRST_LABEL) == 1


# ---- candidates


def test_ranker_equals_measuring_all():
    r = random.Random(4)
    stock = ["old", "river", "RIVER", "oak", "No. 5", "750 mL", "bottled by", "x", "éa", ""]
    pruned = 0
    for _ in range(150):
        expected = " ".join(r.choice(stock) for _ in range(r.randrange(4)))
        texts = [" ".join(r.choice(stock) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(60))]
        ranker, most = candidates.Ranker(expected), r.choice([1, 3, 18])
        want = sorted(((t, partial_ratio(expected.lower(), t.lower())) for t in texts), key=lambda x: -x[1])[:most]
        assert ranker(texts, most) == want
        pruned += len(texts) - ranker.measured
    assert pruned > 100


def test_ratios_of_many_pairs_equal_those_of_each():
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcde éß1") for _ in range(r.randrange(n)))
    pairs = [(some(n), some(m)) for n in (3, 20, 64, 65, 66, 120) for m in (4, 30, 64, 65, 66, 150) for _ in range(6)] + [("a" * 64, "b" + "a" * 63), ("ab" * 32, "ba" * 90), ("x", "y"), ("", "y")]
    assert partial_ratios(pairs).tolist() == [partial_ratio(a, b) for a, b in pairs] and partial_ratios([]).tolist() == []
    values, lists = [a for a, _ in pairs] + [None], [[b for _, b in pairs[i : i + 30]] for i in range(len(pairs))] + [["a", "b"]]
    want = [sorted(((t, partial_ratio((v or "").lower(), t.lower())) for t in texts), key=lambda x: -x[1])[:18] for v, texts in zip(values, lists, strict=True)]
    assert [[(x["candidate"], x["score"]) for x in got] for got in candidates.ranked_lists(values, lists, 18)] == want


def test_blocks_are_cleaned_once_for_all_runs(spark):
    plan = spark.createDataFrame([([" a"],)], "b array<string>").select(evaluation.windows(F.col("b")).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_what_is_wanted_is_worked_out_once_for_all_texts(spark):
    df = spark.createDataFrame([("Old-River", ["Oak", "old", "River", "old"])], "want string, found array<string>")
    want = F.lower(F.regexp_replace("want", "-", " "))
    got = df.select(candidates.ranked_by(want, F.col("found"), lambda w, c: F.when(w.contains(F.lower(c)), F.length(w).cast("double")).otherwise(0.0), 3).alias("r"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [(x.candidate, x.score) for x in got.first().r] == [("old", 9.0), ("River", 9.0), ("old", 9.0)]


def test_candidates(spark):
    rows = [(1, "Old River", [" Old ", "", "River\n Oak", None, "Old"], "Old River"), (2, None, None, None), (3, "", ["a"], "b")]
    df = spark.createDataFrame(rows, "id int, want string, blocks array<string>, body string").withColumn("found", candidates.candidates(F.col("blocks"), F.col("body")))
    got = {r.id: r for r in candidates.ranked(df, "want", "found").collect()}
    assert got[1].found == ["Old", "River Oak", "Old River Oak", "River Oak Old", "Old River Oak Old", "Old River"]
    assert [(x.candidate, x.score) for x in got[1].ranked][:3] == [("Old", 100.0), ("Old River Oak", 100.0), ("Old River Oak Old", 100.0)]
    assert got[2].ranked == [] and [(x.candidate, x.score) for x in got[3].ranked] == [("a", 0.0), ("b", 0.0)]


def test_candidate_query_equals_sorting_all(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    got = {}
    for r in panels.candidate_texts(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.p_partkey, []).append((r.place, r.candidate, r.score))
    for r in panels._candidates(spark, "/root/testdata/sf0.001").collect():
        want = sorted(((c, partial_ratio(r.expected.lower(), c.lower())) for c in r.found), key=lambda x: -x[1])[:18]
        assert sorted(got[r.p_partkey]) == [(i + 1, c, round(s, 6)) for i, (c, s) in enumerate(want)]


# ---- graphs


def test_geometry(spark):
    rows = [([[0.25, 0.5], [0.75, 0.75]],), ([[0.0, 0.0], [4.0, 0.0625]],), ([[0.5, 0.5], [0.25, 0.25]],), (None,), ([[0.1, 0.2]],), ([[0.1, 0.2], [0.3]],), ([[0.1, None], [0.3, 0.4]],)]
    got = [tuple(r.g) for r in spark.createDataFrame(rows, "b array<array<double>>").select(graphs.geometry(F.col("b")).alias("g")).collect()]
    middle = (0.5, 0.5, 0.0, 0.0, 0.0, 0.0)
    assert got == [(0.5, 0.625, 0.5, 0.25, 0.125, 0.1), (0.5, 0.03125, 1.0, 0.0625, 0.0625, 0.8), (0.5, 0.5, 0.0, 0.0, 0.0, 0.0), middle, middle, middle, middle]


def test_feature_graph_of_one_and_of_many(spark):
    rows = [("one", 1, 0.5, 0.5, 1, 1.0), *[("many", i, (i * 7 % 10) / 10, (i * 3 % 10) / 10, i % 2, float(i % 4)) for i in range(12)]]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double, panel int, rank double").withColumns({"shape": F.struct("x", "y"), "features": F.array("x", "y")})
    got = {r.g: r for r in graphs.feature_graphs(df, "g", "id", F.col("rank"), 8, 2).collect()}
    assert got["one"].node_count == 1 and [tuple(e) for e in got["one"].adj] == [(0, 0, 1.0)] and got["one"].x == [[0.5, 0.5]]
    kept = sorted(sorted((r for r in rows if r[0] == "many"), key=lambda r: (-r[5], r[1]))[:8], key=lambda r: r[1])
    assert got["many"].x == [[r[2], r[3]] for r in kept]
    edges = {(a, a) for a in range(8)}
    for a, p in enumerate(kept):
        near = sorted((math.hypot(p[2] - q[2], p[3] - q[3]) + (2.0 if p[4] != q[4] else 0.0), b) for b, q in enumerate(kept) if a != b)[:2]
        edges |= {(a, b) for _, b in near} | {(b, a) for _, b in near}
    degree = {a: sum(x == a for x, _ in edges) for a in range(8)}
    assert {(e.a, e.b): e.weight for e in got["many"].adj} == {(a, b): 1 / degree[a] for a, b in edges}


def test_pages_are_taken_apart_in_portions():
    import pyarrow as pa

    from attestra.sources import forms

    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "html": ["x" * 4, None, "x" * 4, "x" * 30, "", "x"]})
    parts = list(forms.portions(batch, "html", 9))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]] and not list(forms.portions(batch.slice(0, 0), "html"))
