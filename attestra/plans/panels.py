"""Queries over forms, blocks of recognised text and their graphs, and their SQL.

No table holds forms or recognised blocks: they are put together from ``part``, by
SQL that both engines read, and taken apart again. Links are those of ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import records as rc
from ..functions import text as tx
from ..operators import candidates, chain, examples, graphs, headings, mapping, metrics, prefixes, sampling
from ..sources import forms
from .base import load, spread

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- forms

#: What a form of each part says.
FORMS_SQL = """SELECT p_partkey, CAST(25000000000000 + p_partkey AS STRING) AS ttb_id, p_brand || ' & Sons' AS brand_name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS fanciful_name, upper(p_type) AS class_type_description,
  CAST(p_size AS STRING) || '.5' AS alcohol_content, CAST(p_size * 25 AS STRING) || ' mL' AS net_contents, CASE p_partkey % 3 WHEN 0 THEN 'MALT BEVERAGES' WHEN 1 THEN 'WINE' ELSE 'DISTILLED SPIRITS' END AS type_of_product,
  CASE p_partkey % 3 WHEN 0 THEN 'malt_beverage' WHEN 1 THEN 'wine' ELSE 'distilled_spirits' END AS product_type,
  CASE WHEN p_partkey % 5 < 2 THEN 'Imported' ELSE 'Domestic' END AS source_of_product, p_partkey % 5 < 2 AS imported, CASE WHEN p_partkey % 7 = 0 THEN 'surrendered' ELSE 'approved' END AS status,
  'FIRST LINE ' || CAST(p_partkey AS STRING) || chr(10) || 'SECOND LINE' AS special_wording, 'label ' || CAST(p_partkey AS STRING) || ' front.jpg' AS filename, CAST(CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 + p_partkey % 2 END AS INT) AS panels,
  p_size / 4.0 AS width FROM part"""


def rendered(facts: DataFrame) -> DataFrame:
    """A printable form as its registry shows it: labels and data in cells, checked boxes, headings, label images with lines above them."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit(" "), F.lit(" \t "))
    cell = lambda label, value, kind="label": F.concat(F.lit(f'<td>\n <div class="{kind}">{label}</div>\n <div class="data">'), esc(value), F.lit("</div></td>"))
    box = lambda name, value: F.concat(F.lit(f'<input type="checkbox" alt="{name} Other"><input type="checkbox" checked alt="{name} '), value, F.lit('">'))
    image = lambda file, kind: F.concat(F.lit(f'<p class="data">Image Type:</p>\n {kind}\n<br>Actual Dimensions: '), F.col("width").cast("double").cast("string"), F.lit(' inches W X 4 inches H <img src="/registry/publicViewAttachment.do?filename='), file, F.lit(f'&filetype=l" alt="Label Image:  {kind}" width="350">'))
    wording = F.replace(F.col("special_wording"), F.lit("\n"), F.lit("<br>"))
    front, back = image(F.replace("filename", F.lit(" "), F.lit("%20")), "Brand (front)"), image(F.lit("back.jpg"), "Back")
    pieces = [
        F.lit("<!DOCTYPE html><html><head><title>x</title><script>var a = '<div class=\"label\">TTB ID</div>';</script></head><body><form><table><tr>"), cell("TTB ID", F.col("ttb_id")), cell("6. BRAND NAME", F.col("brand_name"), "boldlabel"),
        cell("7. FANCIFUL NAME (if any)", F.col("fanciful_name")), F.lit("</tr><tr>"), cell("12. NET CONTENTS", F.col("net_contents")), cell("13. ALCOHOL CONTENT", F.col("alcohol_content")), F.lit("</tr><tr><td>"),
        box("Source of Product:", F.col("source_of_product")), box("Type of Product:", F.col("type_of_product")), F.lit('</td></tr><tr><td><div class="data">19. SHOW ANY WORDING (a) APPEARING ON LABELS. '), wording,
        F.lit('</div></td></tr></table><div class="boldlabel">STATUS</div><div class="data">THE STATUS IS '), F.upper("status"), F.lit('.</div><div class="boldlabel">CLASS/TYPE DESCRIPTION</div><div class="data">'), esc(F.col("class_type_description")),
        F.lit('</div><img src="logo.gif"><p>AFFIX COMPLETE SET OF LABELS BELOW</p>'), F.when(F.col("panels") >= 1, front).otherwise(""), F.when(F.col("panels") >= 2, back).otherwise(""),
        F.lit('<img src="/registry/publicViewSignature.do?ttbid=1" alt="signature"></form></body></html>'),
    ]
    return facts.select("p_partkey", F.concat(*pieces).alias("html"), F.concat(F.lit("https://registry.example.org/registry/viewDetails.do?ttbid="), "ttb_id").alias("url"))


@query(f"""SELECT p_partkey, ttb_id, brand_name, fanciful_name, class_type_description, alcohol_content, net_contents, type_of_product, source_of_product, status, special_wording, product_type, imported, panels,
  CASE WHEN panels > 0 THEN filename ELSE ttb_id || '.jpg' END AS filename, CASE WHEN panels > 0 THEN 'Brand (front)' END AS first_type, CASE WHEN panels > 0 THEN CAST(width AS DOUBLE) END AS first_width,
  CASE WHEN panels > 1 THEN 'https://registry.example.org/registry/publicViewAttachment.do?filename=back.jpg&filetype=l' END AS second_url FROM ({FORMS_SQL})""")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's form, rendered as a page and taken apart: fields, record and attachments are what went in."""
    facts = spark.sql(FORMS_SQL.replace("FROM part", "FROM {part}"), part=spread(load(spark, sf_dir, "part")))
    found = forms.applications(forms.form_fields(rendered(facts), "html", "url"))
    nth = lambda n, c: F.try_element_at(F.col("attachments"), F.lit(n))[c]
    own = ["p_partkey", "ttb_id", "brand_name", "fanciful_name", "class_type_description", "alcohol_content", "net_contents", "type_of_product", "source_of_product", "status", "special_wording"]
    return found.select(*own, "application.product_type", "application.imported", F.size("attachments").alias("panels"), "application.filename", nth(1, "image_type").alias("first_type"), nth(1, "width_inches").alias("first_width"), nth(2, "source_url").alias("second_url"))


@query(r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS says, trim(regexp_extract(html, '<script>([^\n]*?)</script>', 1)) AS script FROM pages),
  u AS (SELECT page_id, url, script, unnest(hrefs) AS href, trim(regexp_replace(unnest(says), '[ \t]+', ' ', 'g')) AS says, unnest(range(1, len(hrefs) + 1)) AS place FROM a)
  SELECT page_id, CAST(place AS INT) AS place, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS leads_to, says, CASE WHEN place = 1 THEN script ELSE lag(says) OVER (PARTITION BY page_id ORDER BY place) END AS before FROM u""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, where it leads, what it says and the line of text before it."""
    return forms.links(spread(load(spark, sf_dir, "pages")), "page_id", "html", "url")


# ---- blocks

#: The blocks of a part's panel, parted by bars: names, then the warning's heading whole, in words, in pieces, misread, turned round or not at all.
PANEL_SQL = """SELECT p_partkey, p_size, p_name, p_type, p_name || '|' || p_brand || '|' || p_type || '|' || CAST(p_size AS STRING) || '% ALC/VOL|' || CASE p_partkey % 10 WHEN 0 THEN 'GOVERNMENT WARNING: (1) According to' WHEN 1 THEN 'GOVERNMENT|WARNING:'
    WHEN 2 THEN 'Government|and|Warning' WHEN 3 THEN 'GOVERMENT|WARNlNG:' WHEN 4 THEN 'G0VERNMENT|WARN|ING' WHEN 5 THEN '' WHEN 6 THEN 'WARNING|GOVERNMENT WARNING:' WHEN 7 THEN 'GOVERNOR MEN TWARNING' WHEN 8 THEN 'GVT WARNG' ELSE 'GOV|ERN|MENT|WAR|NING|:' END
    || '|' || CAST(p_size * 25 AS STRING) || ' mL|BOTTLED  BY ' || p_brand AS pieces FROM part"""


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``blocks`` of (text, confidence, bbox): some without confidence, some without a box."""
    rows, k = spark.sql(PANEL_SQL.replace("FROM part", "FROM {part}"), part=spread(load(spark, sf_dir, "part"))), F.col("p_partkey")
    box = lambda i: F.array(F.array(i * 0.125, F.lit(0.5)), F.array(i * 0.125 + 0.0625, 0.5 + (k % 3) * 0.25))
    blocks = F.transform(F.split("pieces", r"\|"), lambda t, i: F.struct(t.alias("text"), F.when((k + i) % 6 != 0, ((k + i) % 5) / 8.0).alias("confidence"), F.when((k + i) % 13 != 0, box(i)).alias("bbox")))
    return rows.withColumn("blocks", blocks)


_MASKS = "CASE c " + " ".join(f"WHEN '{c}' THEN {sum(1 << i for i, t in enumerate('GOVERNMENTWARNING') if t == c)}" for c in sorted(set("GOVERNMENTWARNING"))) + " ELSE 0 END"
_LCS = f"CASE WHEN plain = '' THEN 0.0 ELSE (17 - bit_count(list_reduce(list_prepend(131071::BIGINT, list_transform(string_split(substr(plain, 1, 25), ''), lambda c: ({_MASKS})::BIGINT)), lambda s, m: (((s + (s & m)) | (s - (s & m))) & 131071)::BIGINT))) / 17.0 END"
_BLOCKS = f"SELECT *, unnest(string_split(pieces, '|')) AS text, CAST(generate_subscripts(string_split(pieces, '|'), 1) AS INT) - 1 AS i, len(string_split(pieces, '|')) AS n FROM ({PANEL_SQL})"


@query(f"""WITH b AS (SELECT *, CASE WHEN (p_partkey + i) % 6 <> 0 THEN ((p_partkey + i) % 5) / 8.0 END AS sure, (p_partkey + i) % 13 <> 0 AS boxed FROM ({_BLOCKS})),
  r AS (SELECT a.p_partkey, a.i AS first, w.w AS width, any_value(a.n) AS n, string_agg(c.text, ' ' ORDER BY c.i) AS text, upper(regexp_replace(string_agg(c.text, '' ORDER BY c.i), '[^a-zA-Z]', '', 'g')) AS plain, avg(c.sure) AS confidence, bool_and(c.boxed) AS boxed
    FROM b a JOIN (SELECT unnest(range(1, 8)) AS w) w ON a.i + w.w <= a.n JOIN b c ON a.p_partkey = c.p_partkey AND c.i BETWEEN a.i AND a.i + w.w - 1 GROUP BY ALL),
  s AS (SELECT *, CASE WHEN contains(plain, 'GOVERNMENTWARNING') THEN 1.0 WHEN contains(plain, 'GOVERNMENT') AND contains(plain, 'WARNING') THEN 0.95 ELSE {_LCS} END AS score FROM r WHERE boxed),
  t AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, coalesce(confidence, 0) DESC, CASE WHEN width = 1 THEN first ELSE n + first * 8 + width END) AS k FROM s WHERE score >= 0.72)
  SELECT p.p_partkey, trim(t.text) AS text, round(score, 6) AS score, round(confidence, 6) AS confidence, CAST(first AS INT) AS first, CAST(width AS INT) AS width, first * 0.125 AS x0, 0.5 AS y0, (first + width - 1) * 0.125 + 0.0625 AS x1, CASE WHEN first IS NOT NULL THEN 0.5 + p.p_partkey % 3 * 0.25 END AS y1
  FROM part p JOIN t ON p.p_partkey = t.p_partkey AND k = 1""")
def warning_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block or run of blocks of each panel that reads most like the warning's heading, and the box round it."""
    # Exploded rather than filtered: a filter would work the heading out a second time.
    best = _panels(spark, sf_dir).select("p_partkey", F.explode(F.array_compact(F.array(headings.best_heading(F.col("blocks"))))).alias("h"))
    corner = lambda p, c: F.col("h.bbox")[p][c]
    return best.select("p_partkey", "h.text", F.round("h.score", 6).alias("score"), F.round("h.confidence", 6).alias("confidence"), "h.first", "h.width", corner(0, 0).alias("x0"), corner(0, 1).alias("y0"), corner(2, 0).alias("x1"), corner(2, 1).alias("y1"))


_SET = "list_distinct(list_filter(string_split(lower(trim(regexp_replace({}, '[^a-zA-Z0-9]+', ' ', 'g'))), ' '), lambda x: x <> ''))"


@query(f"""WITH b AS (SELECT p_partkey, p_name || ' ' || CAST(p_size AS STRING) AS expected, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, i, pieces FROM ({_BLOCKS}) WHERE trim(text) <> ''),
  o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS at, count(*) OVER (PARTITION BY p_partkey) AS n FROM b),
  r AS (SELECT a.p_partkey, any_value(a.expected) AS expected, w.w * 1000 + a.at AS turn, string_agg(c.text, ' ' ORDER BY c.at) AS candidate FROM o a JOIN (SELECT unnest([1, 2, 3, 5, 8]) AS w) w ON a.at + w.w - 1 <= a.n JOIN o c ON a.p_partkey = c.p_partkey AND c.at BETWEEN a.at AND a.at + w.w - 1 GROUP BY a.p_partkey, w.w, a.at
    UNION ALL SELECT p_partkey, any_value(expected), 9000, trim(regexp_replace(substr(any_value(replace(pieces, '|', chr(10))), 1, 1200), '\\s+', ' ', 'g')) FROM o GROUP BY p_partkey),
  d AS (SELECT p_partkey, candidate, any_value(expected) AS expected, min(turn) AS turn FROM r GROUP BY p_partkey, candidate),
  s AS (SELECT *, 100.0 * len(list_intersect({_SET.format("expected")}, {_SET.format("candidate")})) / len({_SET.format("expected")}) AS score FROM d)
  SELECT p_partkey, candidate, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, turn) AS INT) AS place FROM s QUALIFY place <= 18""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 texts of each panel with the largest share of the words of the part's name and size."""
    p, words = _candidates(spark, sf_dir), ev.tokens(F.col("expected"))
    ranked = candidates.ranked_by(F.col("words"), F.col("found"), lambda want, c: tx.bound(ev.tokens(c), lambda have: ev.word_score(want, have)))
    rows = p.withColumn("words", words).select("p_partkey", F.posexplode(ranked).alias("place", "c"))
    return rows.select("p_partkey", (F.col("place") + 1).alias("place"), "c.candidate", F.round("c.score", 6).alias("score"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.replace("pieces", F.lit("|"), F.lit("\n"))
    found = candidates.candidates(F.transform("blocks", lambda b: b["text"]), full)
    return _panels(spark, sf_dir).select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("expected"), found.alias("found"))


@query()
def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 texts of each panel with the best partial ratio to the part's name and size."""
    rows = candidates.ranked(_candidates(spark, sf_dir), "expected", "found").select("p_partkey", F.posexplode("ranked").alias("place", "c"))
    return rows.select("p_partkey", (F.col("place") + 1).alias("place"), "c.candidate", F.round("c.score", 6).alias("score"))


# ---- graphs

_TERMS = "[['%', 'alc', 'vol', 'alcohol', 'proof'], ['ml', 'milliliter', 'milliliters'], ['l', 'liter', 'liters'], ['oz', 'fl', 'fluid', 'ounce', 'ounces'], ['pint', 'pints'], ['gal', 'gallon', 'gallons']]"
_PLAIN = "lower(trim(regexp_replace({}, '[^a-zA-Z0-9]+', ' ', 'g')))"
#: Nodes of groups of fifty parts: what is expected of the group's field, what was read, a box or none.
NODES_SQL = """SELECT p_partkey, CAST(floor(p_partkey / 50) AS BIGINT) AS graph, CASE p_partkey % 6 WHEN 0 THEN 'brand_name' WHEN 1 THEN 'fanciful_name' WHEN 2 THEN 'class_type' WHEN 3 THEN 'alcohol_content' WHEN 4 THEN 'net_contents' ELSE 'country_of_origin' END AS field,
  CAST(p_size AS STRING) || ' mL ' || p_brand AS expected, p_name || ' ' || CAST(p_size + p_partkey % 2 AS STRING) || CASE p_partkey % 4 WHEN 0 THEN ' ml' WHEN 1 THEN ' fluid ounces' WHEN 2 THEN '' ELSE ' GALLON' END || CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_brand ELSE '' END AS seen,
  CAST((p_partkey % 32) / 32.0 AS DOUBLE) AS similarity, CAST((p_partkey % 8) / 8.0 AS DOUBLE) AS confidence, CAST(1 + p_partkey % 3 AS INT) AS panel,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST((p_partkey % 9) / 8.0 AS DOUBLE) END AS left_x, CAST((p_partkey % 7) / 8.0 AS DOUBLE) AS top_y, CAST((p_partkey % 9) / 8.0 + (p_partkey % 5) / 16.0 AS DOUBLE) AS right_x, CAST((p_partkey % 7) / 8.0 + (p_partkey % 4) / 64.0 AS DOUBLE) AS bottom_y FROM part"""
_SHAPES = f"""SELECT *, CASE WHEN left_x IS NULL THEN 0.5 ELSE greatest(0, least(1, left_x + w / 2)) END AS x, CASE WHEN left_x IS NULL THEN 0.5 ELSE greatest(0, least(1, top_y + h / 2)) END AS y
  FROM (SELECT *, CASE WHEN left_x IS NULL THEN 0 ELSE greatest(0, least(1, right_x - left_x)) END AS w, CASE WHEN left_x IS NULL THEN 0 ELSE greatest(0, least(1, bottom_y - top_y)) END AS h FROM ({NODES_SQL}))"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(NODES_SQL.replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))
    box = F.when(F.col("left_x").isNotNull(), F.array(F.array("left_x", "top_y"), F.array("right_x", "bottom_y")))
    shaped = rows.withColumn("shape", graphs.geometry(box))
    features = graphs.node_features(F.col("field"), F.col("expected"), F.col("seen"), F.col("similarity"), F.col("confidence"), F.col("shape"), F.col("panel"), F.lit(3))
    return shaped.withColumn("features", features)


@query(f"""WITH s AS (SELECT *, {_PLAIN.format("seen")} AS plain, {_PLAIN.format("expected")} AS want FROM ({_SHAPES}))
  SELECT p_partkey, graph, confidence AS f0, round(x, 6) AS f1, round(y, 6) AS f2, w AS f3, h AS f4, round(w * h, 6) AS f5, round(CASE WHEN h > 0 THEN least(w / h, 20) / 20 ELSE 0 END, 6) AS f6, least(length(plain), 40) / 40.0 AS f7, similarity AS f8,
  round(len(list_intersect({_SET.format("expected")}, {_SET.format("seen")})) / len({_SET.format("expected")}), 6) AS f9, CASE WHEN contains(plain, regexp_extract(expected, '[0-9]+')) THEN 1.0 ELSE 0.0 END AS f10,
  CASE WHEN len(list_filter({_TERMS}, lambda ts: len(list_filter(ts, lambda t: contains(want, t))) > 0 AND len(list_filter(ts, lambda t: contains(plain, t))) > 0)) > 0 THEN 1.0 ELSE 0.0 END AS f11, round(panel / 3.0, 6) AS f12, 0.3 AS f13,
  {", ".join(f"CASE WHEN field = '{f}' THEN 1.0 ELSE 0.0 END AS f{14 + i}" for i, f in enumerate(["brand_name", "fanciful_name", "class_type", "alcohol_content", "net_contents", "country_of_origin"]))} FROM s""")
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty numbers of each node."""
    return _nodes(spark, sf_dir).select("p_partkey", "graph", *[F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(20)])


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY similarity + confidence DESC, p_partkey) AS k FROM ({_SHAPES})), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY graph ORDER BY p_partkey) AS INT) - 1 AS pos FROM s WHERE k <= 32),
  d AS (SELECT a.graph, a.pos AS a, b.pos AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) + CASE WHEN a.panel <> b.panel THEN 2.0 ELSE 0 END AS gap FROM t a JOIN t b ON a.graph = b.graph AND a.pos <> b.pos),
  n AS (SELECT graph, a, b FROM d QUALIFY row_number() OVER (PARTITION BY graph, a ORDER BY gap, b) <= 4), e AS (SELECT graph, a, b FROM n UNION SELECT graph, b, a FROM n UNION SELECT graph, pos, pos FROM t)
  SELECT graph, (SELECT count(*) FROM t WHERE t.graph = e.graph) AS node_count, a, b, round(1.0 / count(*) OVER (PARTITION BY graph, a), 6) AS weight FROM e""")
def feature_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each group's graph of its 32 most telling nodes, each joined to its four nearest."""
    g = graphs.feature_graphs(_nodes(spark, sf_dir), "graph", "p_partkey", F.col("similarity") + F.col("confidence"), 32, 4)
    return g.select("graph", "node_count", F.explode("adj").alias("e")).select("graph", "node_count", "e.a", "e.b", F.round("e.weight", 6).alias("weight"))


# ---- records, prefixes, families

#: What another source's record of each part says; keys are spelt in one of three ways, some are missing or null.
RECORDS_SQL = """SELECT p_partkey, CAST(26000000000000 + p_partkey AS STRING) AS ttb_id, p_brand AS brand_name, p_name AS product_name, CASE p_partkey % 3 WHEN 0 THEN 'Malt Beverage' WHEN 1 THEN 'Wine' ELSE 'Distilled Spirits' END AS product_type, p_type AS class_name,
  CASE p_partkey % 4 WHEN 0 THEN 'Imported' WHEN 1 THEN 'Domestic' ELSE '' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'France' WHEN 1 THEN 'USA' ELSE 'KENTUCKY' END AS origin, p_size AS abv, p_size * 25 + 0.5 AS volume FROM part"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, k = spark.sql(RECORDS_SQL.replace("FROM part", "FROM {part}"), part=spread(load(spark, sf_dir, "part"))), F.col("p_partkey")

    def spelt(style: int) -> F.Column:
        key = lambda name: [name, name.upper(), mapping.spellings(name)[-1]][style]
        texts = {key("ttb_id"): "ttb_id", key("brand_name"): "brand_name", key("product_type"): "product_type", key("class_name"): "class_name", key("domestic_or_imported"): "kind", key("origin_name"): "origin"}
        name = F.when(k % 7 == 0, F.to_json(F.struct(F.lit("").alias(key("product_name")), F.col("product_name").alias(key("fanciful_name"))))).otherwise(F.to_json(F.struct(F.col("product_name").alias(key("product_name")))))
        numbers = F.struct(F.when(k % 6 != 0, F.col("abv").cast("double")).alias(key("abv")), F.when(k % 8 != 0, F.col("volume").cast("double")).alias(key("volume")), F.lit("milliliters").alias(key("volume_unit")))
        inner = [F.to_json(F.struct(*[F.col(v).alias(n) for n, v in texts.items()])), name, F.to_json(numbers, {"ignoreNullFields": "false"})]
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.substring(j, 2, F.length(j) - 2) for j in inner]), F.lit("}"))

    return r.select("p_partkey", F.when(k % 29 == 0, "{broken").when(k % 3 == 0, spelt(0)).when(k % 3 == 1, spelt(1)).otherwise(spelt(2)).alias("record"))


@query(f"""SELECT p_partkey, CASE WHEN b THEN '' ELSE ttb_id END AS ttb_id, CASE WHEN b THEN '' ELSE brand_name END AS brand_name, CASE WHEN b THEN '' ELSE product_name END AS fanciful_name,
  CASE WHEN b THEN '' WHEN p_partkey % 3 = 0 THEN 'malt_beverage' WHEN p_partkey % 3 = 1 THEN 'wine' ELSE 'distilled_spirits' END AS product_type, CASE WHEN b THEN '' ELSE class_name END AS class_type,
  CASE WHEN b OR p_partkey % 6 = 0 THEN '' ELSE CAST(abv AS STRING) || '% ALC/VOL' END AS alcohol_content, CASE WHEN b OR p_partkey % 8 = 0 THEN '' ELSE CAST(abv * 25 AS STRING) || '.5 mL' END AS net_contents,
  NOT b AND CASE WHEN kind <> '' THEN kind = 'Imported' ELSE origin <> 'USA' END AS imported, CASE WHEN NOT b AND CASE WHEN kind <> '' THEN kind = 'Imported' ELSE origin <> 'USA' END THEN origin END AS country_of_origin FROM (SELECT *, p_partkey % 29 = 0 AS b FROM ({RECORDS_SQL}))""")
def mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of another source, their keys spelt in several ways, as applications."""
    parsed = mapping.parsed_records(_records(spark, sf_dir), "record")
    return parsed.select("p_partkey", "ttb_id", *[f"application.{c}" for c in ("brand_name", "fanciful_name", "product_type", "class_type", "alcohol_content", "net_contents", "imported", "country_of_origin")])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS STRING) AS k, '' AS other FROM events")
def mapped_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the events' JSON under any spelling; empty where there is none."""
    return mapping.mapped(load(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": ["no_such_key", "K"], "other": ["other_key"]}).select("event_id", "k", "other")


_REASONS = "CASE WHEN p_partkey % 13 = 0 THEN 'existing' WHEN p_name LIKE 'cold%' THEN 'incomplete' WHEN p_brand = 'Brand#5' THEN 'malt' WHEN p_size < 3 THEN 'no_image' WHEN p_size > 40 THEN 'panel_count' ELSE 'kept' END"
_PACKED = f"SELECT * FROM (SELECT *, count(*) FILTER (reason = 'kept') OVER (ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, {_REASONS} AS reason FROM part)) WHERE coalesce(before, 0) < 75"


def _pack(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reasons = {"existing": F.col("p_partkey") % 13 == 0, "incomplete": F.col("p_name").startswith("cold"), "malt": F.col("p_brand") == "Brand#5", "no_image": F.col("p_size") < 3, "panel_count": F.col("p_size") > 40}
    return prefixes.kept_until_enough(load(spark, sf_dir, "part"), ["p_size", "p_partkey"], 75, **reasons)


@query(f"SELECT p_partkey, p_size FROM ({_PACKED}) WHERE reason = 'kept'")
def pack_until_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 75 candidates of a pack by size that no reason is against."""
    return _pack(spark, sf_dir)[0].select("p_partkey", "p_size")


@query(f"SELECT reason, count(*) AS n FROM ({_PACKED}) GROUP BY reason")
def pack_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was kept and passed over, and why, until the pack was full; later candidates are not counted."""
    return _pack(spark, sf_dir)[1]


@query("SELECT o_orderkey, CAST(strptime(d, '%m/%d/%Y') AS DATE) AS completed FROM (SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS d FROM orders WHERE o_orderkey % 9 <> 4 AND o_orderkey % 11 <> 5)")
def usable_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows with a date that are not excluded; what is skipped is counted on the way."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    dated = o.withColumn("given", F.when(k % 9 == 4, "13/41/20x4").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))).withColumn("completed", tx.registry_date(F.col("given")))
    kept, _ = prefixes.counting_skipped(dated, f"skipped {spark.sparkContext.applicationId}", excluded=k % 11 == 5, invalid_date=F.col("completed").isNull())
    return kept.select("o_orderkey", "completed")


@query("""WITH f AS (SELECT p_name AS family, bool_or(p_size % 2 = 1) AND bool_or(p_size % 2 = 0) AS usable FROM part GROUP BY p_name), u AS (SELECT family FROM f WHERE usable OR (SELECT count(*) FILTER (usable) FROM f) < 6),
  r AS (SELECT family, row_number() OVER (ORDER BY sha256('fonts|' || family), family) AS k, count(*) OVER () AS n FROM u)
  SELECT p_partkey, CASE WHEN k <= greatest(1, floor(n * 0.70)) THEN 'train' WHEN k <= greatest(greatest(1, floor(n * 0.70)) + 1, floor(n * 0.85)) THEN 'validation' ELSE 'test' END AS split FROM part JOIN r ON p_name = family""")
def family_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts split by whole families of names that have both odd and even sizes."""
    return sampling.split_families(load(spark, sf_dir, "part"), "p_name", F.col("p_size") % 2 == 1, F.col("p_size") % 2 == 0, "fonts").select("p_partkey", "split")


# ---- examples

_ENGINE_TEXTS = """SELECT c_custkey, 'doctr' AS engine, 'Customer ' || CAST(c_custkey AS STRING) || ' nation ' || CAST(c_nationkey AS STRING) AS body FROM customer
  UNION ALL SELECT c_custkey, 'openocr', CASE WHEN c_custkey % 5 = 0 THEN 'nothing' ELSE 'NATION: ' || CAST(c_nationkey AS STRING) END FROM customer UNION ALL SELECT c_custkey, 'openocr', 'nation' FROM customer WHERE c_custkey % 5 = 1
  UNION ALL SELECT c_custkey, 'paddleocr', CASE WHEN c_custkey % 3 = 0 THEN 'nation' ELSE CAST(c_nationkey AS STRING) || ' nation' END FROM customer WHERE c_custkey % 7 <> 0"""
_EXAMPLES = """WITH t AS (SELECT c_mktsegment, c_custkey, 'nation ' || CAST(c_nationkey AS STRING) AS expected FROM customer),
  o AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('pairs|' || CAST(c_custkey AS STRING)), c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM t),
  p AS (SELECT a.c_mktsegment, a.c_custkey, a.expected, b.expected AS candidate, b.c_custkey AS source, (b.pos - a.pos + a.n) % a.n AS step FROM o a JOIN o b ON b.c_mktsegment = a.c_mktsegment AND a.expected <> b.expected AND a.c_custkey <> b.c_custkey),
  e AS (SELECT c_mktsegment, c_custkey, expected, candidate, source, 0 AS label, CAST(row_number() OVER (PARTITION BY c_mktsegment, c_custkey ORDER BY step) AS INT) AS nth FROM p QUALIFY nth <= 2 UNION ALL SELECT c_mktsegment, c_custkey, expected, expected, c_custkey, 1, 0 FROM t)"""


@query(f"""{_EXAMPLES}, x AS ({_ENGINE_TEXTS}), s AS (SELECT e.*, engine, max(100.0 * len(list_intersect({_SET.format("candidate")}, {_SET.format("body")})) / len({_SET.format("candidate")})) AS score FROM e JOIN x ON e.c_custkey = x.c_custkey WHERE e.c_custkey % 7 <> 0 GROUP BY ALL),
  m AS (SELECT c_custkey, candidate, source, label, nth, max(score) AS best, count(*) FILTER (score >= 90) AS support, string_agg(engine, ';' ORDER BY engine) FILTER (score >= 90) AS engines FROM s GROUP BY ALL),
  d AS (SELECT *, unnest(['any', 'majority', 'unanimous']) AS strategy_name, unnest([best >= 90, support >= 2, support = 3]) AS yes FROM m)
  SELECT c_custkey, candidate, source, label, nth, strategy_name, CAST(yes AS INT) AS predicted, CASE WHEN yes AND label = 1 THEN 'true_positive' WHEN yes THEN 'false_positive' WHEN label = 1 THEN 'false_negative' ELSE 'true_negative' END AS outcome, round(best, 2) AS max_score, CAST(support AS INT) AS support_count, coalesce(engines, '') AS supporting_engines FROM d""")
def ensemble_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as examples with two negatives each, scored by three engines' texts and decided by three strategies."""
    c = load(spark, sf_dir, "customer")
    texts = spark.sql(_ENGINE_TEXTS.replace("FROM customer", "FROM {customer}"), customer=c)
    targets = c.select("c_mktsegment", "c_custkey", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("nation"))
    scored = examples.engine_scores(examples.labelled(targets, ["c_mktsegment"], "c_custkey", "nation", "pairs", 2), texts, "engine", "c_custkey", "body")
    rows = examples.decided(scored, F.lit("class_type"), 90, 95).where(F.col("strategy_name").isin("any", "majority", "unanimous"))
    return rows.select("c_custkey", "candidate", "source", "label", "nth", "strategy_name", "predicted", "outcome", "max_score", "support_count", "supporting_engines")


# ---- buckets, exact shares, rejected clears

_ORIGINS = "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Kentucky' WHEN 1 THEN ' new york ' WHEN 2 THEN 'France' WHEN 3 THEN '' WHEN 4 THEN 'PUERTO RICO' END AS origin, CASE s_suppkey % 5 WHEN 0 THEN 'KY-i-123' WHEN 1 THEN 'DSP-KY-1' ELSE '' END AS permit, CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS said FROM supplier"


@query(f"""WITH b AS (SELECT *, CASE WHEN upper(permit) LIKE '%-I-%' OR upper(trim(coalesce(origin, ''))) = 'FRANCE' THEN 'imported' ELSE 'domestic' END AS bucket FROM ({_ORIGINS}))
  SELECT s_suppkey, bucket, CASE WHEN coalesce(said, bucket = 'imported') THEN 'true' ELSE 'false' END AS imported FROM b""")
def source_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as imported or domestic by permit and origin, and what an application then says."""
    rows = spark.sql(_ORIGINS.replace("FROM supplier", "FROM {supplier}"), supplier=load(spark, sf_dir, "supplier"))
    bucket = rows.withColumn("bucket", tx.source_bucket(F.col("permit"), F.col("origin")))
    return bucket.select("s_suppkey", "bucket", rc.imported_text(F.col("said"), F.col("bucket")).alias("imported"))


@query("""WITH s AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), t AS (SELECT *, floor(0.37 * sum(n) OVER ()) AS target, sum(n) OVER () AS total FROM s), b AS (SELECT *, target * (n / total) AS exact, least(n, CAST(floor(target * (n / total)) AS BIGINT)) AS base FROM t),
  r AS (SELECT *, row_number() OVER (ORDER BY base < n DESC, exact - base DESC, p_type DESC) AS k, target - sum(base) OVER () AS rest FROM b) SELECT p_type, n, CAST(base + CASE WHEN base < n AND k <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """37 of 100 parts, shared out over types exactly."""
    p = load(spark, sf_dir, "part")
    return sampling.allocated_exactly(p.groupBy("p_type").agg(F.count("*").alias("n")), "p_type", "n", int(0.37 * p.count()))


@query("""WITH m AS (SELECT vec_id // 5 AS app, 'c' || (vec_id % 3) AS cls, max(embedding[1]) AS pr FROM embeddings GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY app ORDER BY pr DESC, cls) = 1)
  SELECT app, CASE WHEN cls = 'c1' AND pr < 0.15 THEN 'review' ELSE cls END AS predicted FROM b""")
def rejected_clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable of three classes of each application; a weak clear is reviewed."""
    e = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("app"), F.concat(F.lit("c"), (F.col("vec_id") % 3).cast("string")).alias("cls"), F.col("embedding")[0].cast("double").alias("pr"))
    return metrics.positive_reject(e.groupBy("app", "cls").agg(F.max("pr").alias("pr")), ["app"], "cls", "pr", "c1", "review", 0.15)


# ---- the chain from records and panels to verdicts

#: An application of each part, its registry row (not of all), its panels (not all downloaded or read).
_CHAIN = {
    "parsed": "SELECT CAST(p_partkey AS STRING) AS ttb_id, p_brand AS brand, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS fanciful, p_partkey % 3 = 0 AS imported, CASE WHEN p_partkey % 5 = 0 THEN 'Imported' ELSE 'Domestic' END AS source, CASE WHEN p_partkey % 2 = 0 THEN 'approved' ELSE 'expired' END AS status FROM part",
    "registry": "SELECT chr(39) || CAST(p_partkey AS STRING) || chr(39) AS ttb_id, CASE p_partkey % 3 WHEN 0 THEN 'FRANCE' ELSE 'ITALY' END AS origin_desc FROM part WHERE p_partkey % 7 <> 0",
    "attachments": "SELECT CAST(p_partkey AS STRING) AS ttb_id, n AS panel_order, 'label' || CAST(n AS STRING) || '.png' AS filename, CASE n WHEN 1 THEN 'Front' ELSE 'Back' END AS image_type, CASE WHEN (p_partkey + n) % 8 = 0 THEN '' ELSE 'raw.png' END AS raw_image_path, CAST(CASE WHEN p_partkey % 11 = 0 THEN 404 ELSE 200 END AS INT) AS http_status FROM part CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE n <= 1 + p_partkey % 3",
    "ocr": "SELECT CAST(p_partkey AS STRING) AS ttb_id, n AS panel_order, CASE n WHEN 1 THEN p_name || ' by nobody' WHEN 2 THEN 'BRAND ' || p_brand || ' product of france' ELSE p_brand || ' ' || p_name END AS full_text, CAST(100 * n + p_partkey % 50 AS BIGINT) AS total_ms, (p_partkey + n) % 2 = 0 AS cache_hit FROM part CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE (p_partkey + n) % 9 <> 0",
}
_CHAIN_SQL = f"""WITH parsed AS ({_CHAIN["parsed"]}), registry AS (SELECT replace(ttb_id, chr(39), '') AS ttb_id, origin_desc FROM ({_CHAIN["registry"]})),
  panels AS (SELECT a.*, o.full_text, o.total_ms, o.cache_hit FROM ({_CHAIN["attachments"]}) a LEFT JOIN ({_CHAIN["ocr"]}) o USING (ttb_id, panel_order) WHERE http_status = 200 AND raw_image_path <> ''),
  counts AS (SELECT ttb_id, count(*) AS image_count, count(full_text) AS ocr_image_count, count(*) FILTER (cache_hit) AS cache_hit_count, CAST(sum(total_ms) AS BIGINT) AS total_ocr_ms FROM panels GROUP BY 1 HAVING count(full_text) > 0),
  wanted AS (SELECT p.*, CASE WHEN imported OR source = 'Imported' THEN coalesce(origin_desc, '') ELSE '' END AS origin FROM parsed p LEFT JOIN registry USING (ttb_id) JOIN counts USING (ttb_id)),
  long AS (SELECT ttb_id, unnest(['brand_name', 'fanciful_name', 'class_type', 'alcohol_content', 'net_contents', 'country_of_origin', 'applicant_or_producer']) AS field_name, unnest([brand, fanciful, '', '', '', origin, '']) AS expected FROM wanted),
  tried AS (SELECT *, unnest(vs) AS candidate, generate_subscripts(vs, 1) AS variant FROM (SELECT *, CASE WHEN field_name = 'country_of_origin' THEN [expected, 'Product of ' || expected, 'Made in ' || expected] ELSE [expected] END AS vs FROM long WHERE expected <> '')),
  met AS (SELECT t.*, p.panel_order, p.image_type, p.filename, 100.0 * len(list_intersect({_SET.format("candidate")}, {_SET.format("full_text")})) / len({_SET.format("candidate")}) AS score FROM tried t JOIN panels p ON t.ttb_id = p.ttb_id AND p.full_text IS NOT NULL),
  best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY ttb_id, field_name ORDER BY score DESC, panel_order, variant) = 1),
  fields AS (SELECT l.ttb_id, l.field_name, l.expected, CASE WHEN b.score IS NULL THEN 'not_applicable' WHEN b.score >= 90 THEN 'pass' ELSE 'needs_review' END AS verdict, CASE WHEN b.score IS NULL THEN 'no_expected_value' WHEN b.score >= 90 THEN 'matched' WHEN b.score >= 75 THEN 'ambiguous_match' ELSE 'not_found' END AS outcome,
    round(coalesce(b.score, 0), 2) AS score, CASE WHEN b.score > 0 THEN b.panel_order END AS best_panel_order, CASE WHEN b.score > 0 THEN b.image_type END AS best_panel_type, CASE WHEN b.score > 0 THEN b.filename END AS best_panel_filename FROM long l LEFT JOIN best b USING (ttb_id, field_name)),
  applications AS (SELECT w.ttb_id, w.status, w.source AS source_of_product, c.* EXCLUDE (ttb_id), CASE WHEN coalesce(v.ok, false) THEN 'pass' ELSE 'needs_review' END AS overall_verdict FROM wanted w JOIN counts c USING (ttb_id) JOIN (SELECT ttb_id, bool_and(verdict = 'pass') FILTER (verdict <> 'not_applicable') AS ok FROM fields GROUP BY 1) v USING (ttb_id))"""


def _chained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = spread(load(spark, sf_dir, "part"))
    given = {k: spark.sql(q.replace("FROM part", "FROM {part}"), part=part) for k, q in _CHAIN.items()}
    none = [F.lit("").alias(c) for c in ("class_type", "alcohol_content", "net_contents")]
    form = F.struct(F.col("brand").alias("brand_name"), F.col("fanciful").alias("fanciful_name"), F.lit("").alias("class_type_description"), *none[1:], F.col("source").alias("source_of_product"), "status", F.lit("").alias("applicant_name_address"))
    parsed = given["parsed"].select("ttb_id", form.alias("form_fields"), F.struct(F.lit(None).cast("string").alias("brand_name"), F.col("fanciful").alias("fanciful_name"), *none, "imported").alias("application"))
    wanted, panels = chain.expected(parsed, given["registry"]), chain.read_panels(given["attachments"], given["ocr"])
    return wanted, panels, chain.field_results(wanted, panels)


@query(f"{_CHAIN_SQL} SELECT * FROM fields")
def chain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every application with a recognised panel, and the panel that bears it out best."""
    return _chained(spark, sf_dir)[2].drop("at", "evidence_text", "reviewer_action")


@query(f"{_CHAIN_SQL} SELECT * FROM applications")
def chain_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with a recognised panel: panels, time, verdict; the others are dropped."""
    return chain.application_results(*_chained(spark, sf_dir))


@query(f"""{_CHAIN_SQL} SELECT count(*) AS application_count, count(*) FILTER (overall_verdict = 'pass') AS pass_count, count(*) FILTER (overall_verdict = 'needs_review') AS needs_review_count, CAST(sum(ocr_image_count) AS BIGINT) AS image_count, CAST(sum(cache_hit_count) AS BIGINT) AS cache_hit_count,
  round(avg(total_ocr_ms), 2) AS mean_per_application, max(total_ocr_ms) AS max_per_application FROM applications""")
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.summary(chain.application_results(*_chained(spark, sf_dir)))


@query(f"""{_CHAIN_SQL} SELECT field_name, count(*) FILTER (verdict <> 'not_applicable') AS attempted, count(*) FILTER (verdict = 'pass') AS matched, count(*) FILTER (verdict = 'needs_review') AS needs_review,
  round(count(*) FILTER (verdict = 'pass') / nullif(count(*) FILTER (verdict <> 'not_applicable'), 0), 4) AS match_rate, round(avg(score) FILTER (verdict <> 'not_applicable'), 2) AS mean_score FROM fields GROUP BY 1""")
def chain_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.field_summary(_chained(spark, sf_dir)[2])
