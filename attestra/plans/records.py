"""Queries of lists, integrity joins, mappings and summaries, and their SQL.

No table holds registries, attachments or crops; each query says which columns of
the driver's tables stand for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as rc
from ..functions import text as tx
from ..functions.evidence import overlap
from ..operators import metrics, records
from .base import ENGINES, ENGINES_SQL, engine_scores, load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def picked(values: list[str], n) -> F.Column:
    """The value at a number from zero."""
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def sql_picked(values: list[str], n: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{n} + 1]"


# ---- mappings

_KINDS = ["Malt Beverage", "craft BEER", "Distilled Spirits", "table wine", "hard cider", ""]
_FROM, _ORIGINS = ["imported", "Domestic", "", "''"], ["American", "FRANCE", "", "U.S."]


@query(f"""WITH p AS (SELECT p_partkey, lower({sql_picked(_KINDS, "p_partkey % 6")}) AS k, {sql_picked(_FROM, "p_partkey % 4")} AS said, lower({sql_picked(_ORIGINS, "p_size % 4")}) AS origin FROM part)
  SELECT p_partkey, CASE WHEN k LIKE '%malt%' OR k LIKE '%beer%' THEN 'malt_beverage' WHEN k LIKE '%spirit%' OR k LIKE '%distilled%' THEN 'distilled_spirits' WHEN k LIKE '%wine%' THEN 'wine' ELSE replace(k, ' ', '_') END AS slug,
  CASE WHEN k LIKE '%malt%' THEN 'malt_beverage' WHEN k LIKE '%distilled%' OR k LIKE '%spirit%' THEN 'distilled_spirits' WHEN k LIKE '%wine%' THEN 'wine' ELSE '' END AS form_slug,
  lower(said) = 'imported' AS flag, CASE WHEN said <> '' THEN lower(said) = 'imported' ELSE origin <> '' AND origin NOT IN ('american', 'united states', 'usa', 'u.s.', 'us') END AS imported FROM p""")
def product_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    kind, said, origin = picked(_KINDS, F.col("p_partkey") % 6), picked(_FROM, F.col("p_partkey") % 4), picked(_ORIGINS, F.col("p_size") % 4)
    return p.select("p_partkey", rc.product_slug(kind).alias("slug"), rc.form_product(kind).alias("form_slug"), rc.imported_flag(said).alias("flag"), rc.imported(said, origin).alias("imported"))


@query("""SELECT CAST(s_suppkey AS STRING) AS ttb_id, 'P-' || s_nationkey AS permit_no, '' AS serial_number, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '0' || CAST(s_suppkey % 9 + 1 AS STRING) || '/15/2020' END AS latest,
  coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '0' || CAST(s_suppkey % 9 + 1 AS STRING) || '/15/2020' END, ''), '01/01/2019') AS completed_date, s_name AS brand_name FROM supplier""")
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as another source's records; the later of two date columns counts if it is given."""
    s = load(spark, sf_dir, "supplier")
    latest = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("0"), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit("/15/2020")))
    source = s.select(F.concat(F.lit("'"), F.col("s_suppkey").cast("string"), F.lit("'")).alias("TTB_ID"), F.concat(F.lit("P-"), F.col("s_nationkey").cast("string")).alias("PERMIT_NUMBER"), latest.alias("LATEST_UPDATE_DATE"), F.lit("01/01/2019").alias("APPROVAL_DATE"), F.col("s_name").alias("BRAND_NAME"))
    return source.select(tx.unquoted(F.col("TTB_ID")).alias("ttb_id"), F.col("PERMIT_NUMBER").alias("permit_no"), F.lit("").alias("serial_number"), F.col("LATEST_UPDATE_DATE").alias("latest"), F.coalesce(F.nullif("LATEST_UPDATE_DATE", F.lit("")), "APPROVAL_DATE").alias("completed_date"), F.col("BRAND_NAME").alias("brand_name"))


_LINES = ["ACME LLC\n12 Main St\nBLUE MOON (Used on label)", "\n  Old Vine  \nrest", "", "One Line"]


@query(f"""WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS own, c_mktsegment AS form, c_custkey % 4 AS k, c_custkey % 2 = 0 AS imp FROM customer)
  SELECT c_custkey, coalesce(nullif(own, ''), form) AS class_type, CASE WHEN imp THEN 'NATION ' || c_custkey ELSE '' END AS country, CASE k WHEN 0 THEN 'BLUE MOON' WHEN 1 THEN 'Old Vine' WHEN 2 THEN '' ELSE 'One Line' END AS producer FROM c""")
def expected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an application leads one to expect: its own value, else its form's; the country only if imported; who is named on the label."""
    c = load(spark, sf_dir, "customer")
    own, block = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")), picked(_LINES, F.col("c_custkey") % 4)
    country = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("NATION "), F.col("c_custkey").cast("string"))).otherwise("")
    return c.select("c_custkey", F.coalesce(F.nullif(own, F.lit("")), "c_mktsegment").alias("class_type"), country.alias("country"), rc.expected_producer(block).alias("producer"))


_PATHS = ["/home/u/data/work/public-cola/raw/a.html", "data/work/public-cola/b/c.png", "/tmp/else.png", "/x/data/work/other.png"]


@query(f"WITH p AS (SELECT p_partkey, {sql_picked(_PATHS, 'p_partkey % 4')} AS path FROM part) SELECT p_partkey, CASE WHEN regexp_matches(path, '(^|/)data/work/public-cola/') THEN '/app/work/' || regexp_extract(path, 'public-cola/(.*)$', 1) ELSE path END AS path, 'ocr/' || p_partkey || '/' || regexp_extract(path, '([^/]*)\\.[^.]*$', 1) || '.json' AS cache FROM p")
def moved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").withColumn("path", picked(_PATHS, F.col("p_partkey") % 4))
    return p.select("p_partkey", rc.moved_path(F.col("path"), "/app/work").alias("path"), F.concat(F.lit("ocr/"), F.col("p_partkey").cast("string"), F.lit("/"), tx.file_stem(F.col("path")), F.lit(".json")).alias("cache"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'https://host.example/get?filetype=l' ELSE 'https://host.example/get?filename=' || replace(p_name, ' ', '%20') || '%23' || p_partkey || '.jpg&filetype=' || CASE WHEN p_partkey % 3 = 1 THEN 'l' ELSE 's' END END AS link FROM part""")
def attachment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("%23"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    tail = F.when(F.col("p_partkey") % 3 == 0, "filetype=l").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("filename="), name)).otherwise(F.concat(F.lit("filename="), name, F.lit("&filetype=s")))
    return p.select("p_partkey", rc.encoded_link(F.concat(F.lit("https://host.example/get?"), tail)).alias("link"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"k\":' || json_extract(props, '$.k') || '}' AS packed, 'none' AS other FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of JSON text, a default where a key is absent, and JSON written again."""
    e = load(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint, other string"))
    return e.select("event_id", "p.k", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("p.k").alias("k"))).alias("packed"), F.coalesce("p.other", F.lit("none")).alias("other"))


# ---- lists and filters

_REGISTRY = "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS completed, o_custkey FROM orders"


@query(f"SELECT o_orderkey, completed FROM ({_REGISTRY}) ORDER BY completed DESC, o_orderkey LIMIT 50")
def listed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last by date as it is written, month first, then by id; dates are text, as the lists of the source sort them."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("completed"))
    return records.listed(o, [F.desc("completed"), F.col("o_orderkey")], 50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT event_id FROM events WHERE user_id % 5 = 0)")
def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit list of ids in place of the whole table, without a limit."""
    ids = load(spark, sf_dir, "events").where("user_id % 5 = 0").select("event_id")
    return records.listed(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], None, ids.withColumnRenamed("event_id", "o_orderkey"), "o_orderkey")


_ATTACHED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'p' || o_orderkey END AS path, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 404 ELSE 200 END AS status FROM orders"


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    path, status = F.when(k % 4 == 0, "").when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("p"), k.cast("string"))), F.when(k % 5 == 0, F.lit(None)).when(k % 6 == 0, 404).otherwise(200)
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", path.alias("path"), status.alias("status"))


@query(f"SELECT o_orderkey, o_custkey FROM ({_ATTACHED}) WHERE path IS NULL OR path = '' OR status IS NULL OR status <> 200")
def pending_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.pending(_attached(spark, sf_dir), "path", "status").select("o_orderkey", "o_custkey")


@query(f"SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS panel FROM ({_ATTACHED}) WHERE status = 200 AND path <> ''")
def downloaded_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.downloaded(_attached(spark, sf_dir), "path", "status")
    return rows.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("panel"))


@query("SELECT p_partkey, p_name FROM part p WHERE p_name IS NOT NULL AND p_size > 5 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_quantity > 45)")
def usable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a name and images (sizes over 5 stand for them) that are not excluded."""
    out = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return records.missing(load(spark, sf_dir, "part").where("p_name IS NOT NULL AND p_size > 5"), out, "p_partkey", "l_partkey").select("p_partkey", "p_name")


@query("SELECT user_id AS job, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AND user_id % 10 <> 0")
def expired_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that were not touched for an hour, but for those whose upload goes on (ids that end with 0)."""
    e = load(spark, sf_dir, "events")
    last, now = e.groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("last")), e.agg(F.max("ts").alias("t")).first()["t"]
    return last.where((F.col("last") < F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")) & (F.col("job") % 10 != 0))


@query("""WITH d AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'override' WHEN 'signup' THEN 'escalate' WHEN 'purchase' THEN 'reject' ELSE 'drop' END AS decision, CASE WHEN user_id % 2 = 0 THEN ' ' ELSE 'seen' END AS note FROM events)
  SELECT coalesce(CASE WHEN decision = 'drop' THEN 'Invalid reviewer decision' WHEN decision IN ('override', 'escalate') AND trim(note) = '' THEN 'Override and escalation decisions require a note.' END, 'valid') AS found, decision, count(*) AS n FROM d GROUP BY ALL""")
def decision_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "accept", "click": "override", "signup": "escalate", "purchase": "reject"}
    said = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("drop"))
    d = load(spark, sf_dir, "events").select(said.alias("decision"), F.when(F.col("user_id") % 2 == 0, " ").otherwise("seen").alias("note"))
    return d.groupBy(F.coalesce(rc.decision_error(F.col("decision"), F.col("note")), F.lit("valid")).alias("found"), "decision").agg(F.count("*").alias("n"))


@query("SELECT user_id AS job, min(ts) AS created FROM events WHERE event_type = 'signup' GROUP BY 1 ORDER BY created, job LIMIT 20")
def oldest_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("job")).agg(F.min("ts").alias("created"))
    return records.listed(e, [F.col("created"), F.col("job")], 20)


@query("SELECT user_id AS job, max(ts) AS touched FROM events GROUP BY 1 ORDER BY touched DESC, job LIMIT 20")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.max("ts").alias("touched"))
    return records.listed(e, [F.desc("touched"), F.col("job")], 20)


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score FROM embeddings v, q ORDER BY score DESC, vec_id LIMIT 18")
def top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 most similar to one text (the first vector stands for it)."""
    v = load(spark, sf_dir, "embeddings")
    own = v.where("vec_id = 0").first()["embedding"]
    dot = F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in own]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return records.listed(v.select("vec_id", F.round(dot, 6).alias("score")), [F.desc("score"), F.col("vec_id")], 18)


# ---- integrity


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 100000)")
def missing_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a manifest (customers) without a file (an order)."""
    return records.missing(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_nationkey < 12)")
def unreferenced_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (users of events) that no item names."""
    return records.missing(load(spark, sf_dir, "events").select("user_id").distinct(), load(spark, sf_dir, "customer").where("c_nationkey < 12"), "user_id", "c_custkey")


@query("SELECT CASE WHEN o.o_custkey IS NULL THEN 'unmatched' ELSE 'fetched' END AS state, count(*) AS n FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c.c_custkey GROUP BY 1")
def fetched_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected rows by whether they were fetched; any unmatched one is an error of the split."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").select("o_custkey").distinct()
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.when(F.col("o_custkey").isNull(), "unmatched").otherwise("fetched").alias("state")).agg(F.count("*").alias("n"))


_REFS = "SELECT p_partkey, unnest([p_partkey % 40, p_partkey % 7 + p_size * 3]) AS ref FROM part"


@query(f"SELECT DISTINCT p_partkey, CAST(ref AS BIGINT) AS ref FROM ({_REFS}) r WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = r.ref)")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of criteria (two of each part) to sources (suppliers) that do not exist."""
    p = load(spark, sf_dir, "part").withColumn("refs", F.array(F.col("p_partkey") % 40, (F.col("p_partkey") % 7 + F.col("p_size") * 3).cast("bigint")))
    return records.dangling(p, "p_partkey", "refs", load(spark, sf_dir, "supplier"), "s_suppkey").select("p_partkey", "ref")


@query(f"""SELECT 'no_expected' AS kind, CAST(c_custkey AS STRING) AS item FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 100000) UNION ALL SELECT 'negative_balance', CAST(s_suppkey AS STRING) FROM supplier WHERE s_acctbal < 1000
  UNION ALL SELECT 'repeated_name', p_name FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'dangling_ref', CAST(p_partkey AS STRING) FROM (SELECT DISTINCT p_partkey, ref FROM ({_REFS}) r WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = r.ref))""")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with fixtures and sources, in one list."""
    names = load(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")
    return records.violations(no_expected=missing_uploads(spark, sf_dir), negative_balance=load(spark, sf_dir, "supplier").where("s_acctbal < 1000"), repeated_name=names, dangling_ref=dangling_refs(spark, sf_dir))


_IMAGES = "SELECT s_nationkey, s_suppkey, s_name || '.png' AS name, CASE s_suppkey % 4 WHEN 0 THEN s_name || '.png' WHEN 1 THEN s_name || '.jpg' WHEN 2 THEN 'front_' || s_name || '_1.gif' ELSE 'else' || s_suppkey END AS attachment FROM supplier"


@query(f"""WITH s AS ({_IMAGES}), m AS (SELECT i.s_nationkey, i.name, a.attachment, a.s_suppkey, CASE WHEN i.name = a.attachment THEN 1 WHEN regexp_replace(i.name, '\\.[^.]*$', '') = regexp_replace(a.attachment, '\\.[^.]*$', '') THEN 2 WHEN contains(a.attachment, regexp_replace(i.name, '\\.[^.]*$', '')) THEN 3 END AS how
  FROM s i JOIN s a ON a.s_nationkey = i.s_nationkey) SELECT s_nationkey, name, attachment, how FROM m WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_nationkey, name ORDER BY how, s_suppkey, attachment) = 1""")
def image_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of images of an application (suppliers of a nation)."""
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat("s_name", F.lit(".png"))).when(k == 1, F.concat("s_name", F.lit(".jpg"))).when(k == 2, F.concat(F.lit("front_"), "s_name", F.lit("_1.gif"))).otherwise(F.concat(F.lit("else"), F.col("s_suppkey").cast("string")))
    rows = s.select("s_nationkey", "s_suppkey", F.concat("s_name", F.lit(".png")).alias("name"), name.alias("attachment"))
    return records.attachment_of(rows.select("s_nationkey", "name"), rows, "s_nationkey", "name", "attachment", "s_suppkey")


@query("""WITH f AS (SELECT DISTINCT regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM part UNION ALL SELECT 'stranger.png'), a AS (SELECT regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g') AS name, count(*) AS k FROM part WHERE p_partkey % 3 = 0 AND p_size < 12 GROUP BY 1)
  SELECT file, coalesce(k, 0) AS matches, CASE WHEN k IS NULL THEN 'unmatched' WHEN k = 1 THEN 'imported' ELSE 'ambiguous' END AS status FROM f LEFT JOIN a ON a.name = f.file""")
def import_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").withColumn("name", tx.safe_name(F.col("p_name")))
    files = p.select(F.col("name").alias("file")).distinct().unionByName(spark.createDataFrame([("stranger.png",)], "file string"))
    return records.import_status(files, p.where("p_partkey % 3 = 0 AND p_size < 12"), "file", "name")


@query("SELECT e.event_id, coalesce(c.c_name, 'unknown') AS name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_mktsegment <> 'MACHINERY'")
def payload_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a payload (events) with what the manifest (customers) says of them."""
    c = load(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_name")
    return load(spark, sf_dir, "events").join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.coalesce("c_name", F.lit("unknown")).alias("name"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)")
def resumed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do: items whose job has no result yet."""
    e = load(spark, sf_dir, "events")
    return records.missing(e.where("event_type = 'view'"), e.where("event_type = 'purchase' AND value > 150"), "user_id", "user_id").select("event_id")


# ---- headings and applications

_CROPS = """SELECT v.vec_id AS image, e.engine, round(0.5 + CAST(embedding[1] AS DOUBLE), 3) AS score, CASE WHEN v.vec_id % 3 = 0 THEN NULL ELSE round(CAST(embedding[2] AS DOUBLE), 1) END AS conf FROM embeddings v, (VALUES (0, 'doctr'), (1, 'paddleocr'), (2, 'openocr')) e(i, engine) WHERE (v.vec_id + e.i) % 4 <> 0"""


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images met with the engines that have read them; the others are skipped."""
    v = load(spark, sf_dir, "embeddings").withColumn("e", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("engine")) for i, n in enumerate(ENGINES)]))).where("(vec_id + e.i) % 4 <> 0")
    return v.select(F.col("vec_id").alias("image"), "e.engine", F.round(0.5 + F.col("embedding")[0].cast("double"), 3).alias("score"), F.when(F.col("vec_id") % 3 != 0, F.round(F.col("embedding")[1].cast("double"), 1)).alias("conf"))


@query(f"SELECT engine, count(*) AS n, count(conf) AS with_conf, round(avg(score), 6) AS score FROM ({_CROPS}) GROUP BY engine")
def crops_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crops(spark, sf_dir).groupBy("engine").agg(F.count("*").alias("n"), F.count("conf").alias("with_conf"), F.round(F.avg("score"), 6).alias("score"))


@query(f"SELECT image, engine, score, conf FROM ({_CROPS}) QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, coalesce(conf, -1) DESC, CASE engine WHEN 'doctr' THEN 1 WHEN 'paddleocr' THEN 2 ELSE 3 END) = 1")
def best_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.best_headings(_crops(spark, sf_dir), "image", "score", "conf", "engine", ENGINES)


@query(f"""WITH b AS (SELECT DISTINCT image FROM ({_CROPS}) WHERE score >= 0.55) SELECT CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN image IS NULL THEN 'no_warning' ELSE 'heading' END AS pool, count(*) AS n FROM embeddings LEFT JOIN b ON b.image = vec_id GROUP BY ALL""")
def heading_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a heading, and the rest, by split."""
    v, good = load(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split")), best_headings(spark, sf_dir).where("score >= 0.55").select("image")
    rest = records.missing(v, good, "vec_id", "image").withColumn("pool", F.lit("no_warning"))
    return v.join(good, F.col("vec_id") == F.col("image"), "left_semi").withColumn("pool", F.lit("heading")).unionByName(rest).groupBy("split", "pool").agg(F.count("*").alias("n"))


_SAID = "SELECT vec_id % 60 AS app, CASE vec_id % 2 WHEN 0 THEN 'caps' ELSE 'bold' END AS task, CASE label % 2 WHEN 0 THEN 'svm' ELSE 'cnn' END AS model, CASE WHEN label < 2 THEN 'yes' WHEN label < 6 THEN 'unsure' ELSE 'no' END AS label FROM embeddings WHERE vec_id % 11 <> 0"


@query(f"""WITH s AS ({_SAID}), f AS (SELECT app, task, model FROM (SELECT range AS app FROM range(66)), (VALUES ('caps'), ('bold')) t(task), (VALUES ('svm'), ('cnn')) m(model)), d AS (SELECT app, task, model, bool_or(label = 'yes') AS y, bool_or(label = 'unsure') AS u FROM s GROUP BY ALL)
  SELECT f.app, f.task, f.model, CASE WHEN y IS NULL THEN 'no_heading_found' WHEN y THEN 'cleared_expected_positive' WHEN u THEN 'needs_review' ELSE 'flagged_negative' END AS decision FROM f LEFT JOIN d USING (app, task, model)""")
def app_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").where("vec_id % 11 <> 0")
    said = v.select((F.col("vec_id") % 60).alias("app"), picked(["caps", "bold"], F.col("vec_id") % 2).alias("task"), picked(["svm", "cnn"], F.col("label") % 2).alias("model"), F.when(F.col("label") < 2, "yes").when(F.col("label") < 6, "unsure").otherwise("no").alias("label"))
    return records.app_decisions(spark.range(66).withColumnRenamed("id", "app"), ["caps", "bold"], ["svm", "cnn"], said, "app", "yes", "unsure")


# ---- summaries


@query("SELECT event_type AS status, CAST(user_id % 3 AS STRING) AS split, count(*) AS n, count(DISTINCT user_id) AS engines, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def conveyor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("status"), (F.col("user_id") % 3).cast("string").alias("split")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("engines"), F.round(F.sum("value"), 2).alias("total"))


@query(f"SELECT count(*) AS selected, count(*) FILTER (status = 200) AS fetched, count(*) FILTER (path <> '') AS downloaded, count(*) FILTER ((path IS NULL OR path = '') AND status IS NOT NULL) AS failed FROM ({_ATTACHED})")
def etl_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, none = _attached(spark, sf_dir), F.coalesce(F.col("path"), F.lit("")) == ""
    return records.funnel(a, fetched=F.coalesce(F.col("status") == 200, F.lit(False)), downloaded=~none, failed=none & F.col("status").isNotNull())


_SPLIT = "CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'dev' ELSE 'test' END"


@query(f"""WITH o AS (SELECT {_SPLIT} AS split, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS status, o_orderpriority AS priority FROM orders) SELECT split, 'month' AS "by", month AS value, count(*) AS n FROM o GROUP BY ALL
  UNION ALL SELECT split, 'status', status, count(*) FROM o GROUP BY ALL UNION ALL SELECT split, 'priority', priority, count(*) FROM o GROUP BY ALL""")
def split_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each split is made up, by several columns in one pass."""
    o = load(spark, sf_dir, "orders").select(F.expr(_SPLIT).alias("part"), tx.month_key(F.col("o_orderdate")).alias("month"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return records.distributions(o, "part", "month", "status", "priority")


@query(f"WITH s AS (SELECT o_custkey, count(DISTINCT {_SPLIT}) AS k FROM orders GROUP BY 1) SELECT k AS splits, count(*) AS n FROM s GROUP BY 1")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by how many splits they are in; more than one is a leak."""
    s = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct(F.expr(_SPLIT)).alias("splits"))
    return s.groupBy("splits").agg(F.count("*").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS candidates, count(DISTINCT o_custkey) AS applicants, count(*) FILTER (o_totalprice > 200000) AS selected FROM orders GROUP BY ALL")
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.groupBy(tx.month_key(F.col("o_orderdate")).alias("month"), "o_orderstatus").agg(F.count("*").alias("candidates"), F.count_distinct("o_custkey").alias("applicants"), F.count_if(F.col("o_totalprice") > 200000).alias("selected"))


@query("WITH r AS (SELECT c_custkey, c_mktsegment, sha256('sheet|' || c_custkey) AS mark FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY mark, c_custkey) AS n FROM r) SELECT c_custkey, c_mktsegment FROM k ORDER BY CAST(n > 6 AS INT), mark, c_custkey LIMIT 50")
def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.contact_sheet(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "sheet", ["c_custkey"], 6, 50)


@query("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT vec_id, round(CASE WHEN vec_id % 9 = 0 THEN 0.0 ELSE list_sum(list_transform(embedding[1:1 + vec_id % 5], lambda x: CAST(x AS DOUBLE))) / len(embedding[1:1 + vec_id % 5]) END, 6) AS confidence FROM embeddings")
def token_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a text's token probabilities (a vector's first coordinates), 0 for no token."""
    some = F.when(F.col("vec_id") % 9 == 0, F.array().cast("array<double>")).otherwise(F.slice("embedding", F.lit(1), (F.col("vec_id") % 5 + 1).cast("int")).cast("array<double>"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(rc.mean_or_zero(some), 6).alias("confidence"))


@query("""WITH t AS (SELECT user_id, count(*) AS processed, 120 AS total, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS s FROM events GROUP BY 1)
  SELECT user_id, round(100.0 * processed / total, 1) AS progress, s AS elapsed, round(s / processed, 4) AS each FROM t""")
def job_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress, elapsed time and time for each item of jobs of 120 items."""
    second = lambda c: F.date_trunc("second", c).cast("timestamp_ntz")
    t = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return t.select("user_id", F.round(100.0 * F.col("n") / 120, 1).alias("progress"), F.timestamp_diff("SECOND", second("a"), second("b")).alias("elapsed")).join(t.select("user_id", "n"), "user_id").select("user_id", "progress", "elapsed", F.round(F.col("elapsed") / F.col("n"), 4).alias("each"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'existing' WHEN p_name LIKE 'cold%' THEN 'incomplete' WHEN p_brand = 'Brand#5' THEN 'malt' WHEN p_size < 3 THEN 'no_image' WHEN p_size > 40 THEN 'panel_count' ELSE 'kept' END AS reason FROM part) SELECT reason, count(*) AS n FROM p GROUP BY reason""")
def demo_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a demonstration by the first reason against them."""
    reason = records.first_reason(existing=F.col("p_partkey") % 13 == 0, incomplete=F.col("p_name").startswith("cold"), malt=F.col("p_brand") == "Brand#5", no_image=F.col("p_size") < 3, panel_count=F.col("p_size") > 40)
    return load(spark, sf_dir, "part").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# ---- entities, examples, graphs

_GROUPS = {"brand_name": ["view", "signup"], "class_type": ["click"]}


@query("""WITH e AS (SELECT user_id, event_type AS grp, 'k' || json_extract(props, '$.k') AS word, event_id AS pos FROM events WHERE value >= 20), f(field, grp) AS (VALUES ('brand_name', 'view'), ('brand_name', 'signup'), ('class_type', 'click')),
  w AS (SELECT user_id, field, word, min(pos) AS first_at FROM e JOIN f USING (grp) GROUP BY ALL) SELECT user_id, field, string_agg(word, chr(10) ORDER BY first_at, word) AS entity_text FROM w GROUP BY ALL""")
def entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("group"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("word"), F.col("event_id").alias("position"), F.col("value").alias("score"))
    return records.entity_texts(e, "user_id", _GROUPS, 20.0)


@query(f"""WITH e AS ({ENGINES_SQL}), v AS (SELECT *, CAST(s1 >= 60 AS INT) + CAST(s2 >= 60 AS INT) + CAST(s3 >= 60 AS INT) AS k, greatest(s1, s2, s3) AS best, round(40 + vec_id % 60, 1) AS ner FROM e),
  g AS (SELECT *, CASE WHEN field = 'alcohol_content' THEN k = 3 ELSE k >= 2 OR (field = 'brand_name' AND best >= 80) END AS safe, field IN ('brand_name', 'class_type') AND ner >= 60 AS lower FROM v),
  p AS (SELECT field, unnest([struct_pack(s := 'entities_only', y := ner >= 60), struct_pack(s := 'entities_or_safe', y := safe OR lower), struct_pack(s := 'review_safe', y := safe OR (lower AND best >= 55))]) AS x FROM g)
  SELECT x.s AS policy, field, count(*) AS n, count(*) FILTER (x.y) AS yes FROM p GROUP BY ALL""")
def entity_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_scores(spark, sf_dir).withColumn("ner", F.round(40 + F.col("vec_id") % 60, 1))
    safe = metrics.votes(F.col("scores"), F.col("field"), 60.0, 80.0)["government_safe"]
    said = records.entity_policies(F.col("ner"), F.col("field"), safe, F.array_max(F.map_values("scores")), 60.0, 55.0)
    return e.select("field", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("y")) for n, c in said.items()])).alias("v")).groupBy("v.policy", "field").agg(F.count("*").alias("n"), F.count_if("v.y").alias("yes"))


_EX = "SELECT vec_id, label % 3 AS field, round(50 + 200 * CAST(embedding[1] AS DOUBLE), 4) AS score, round(50 + 200 * CAST(embedding[2] AS DOUBLE), 4) AS other FROM embeddings"


@query(f"""WITH e AS ({_EX}), x AS (SELECT field, score, 1 AS label FROM e UNION ALL SELECT field, other, 0 FROM e) SELECT field, label, CASE WHEN score >= 60 AND label = 1 THEN 'true_clear' WHEN score >= 60 THEN 'false_clear' WHEN label = 1 THEN 'false_reject' ELSE 'true_reject' END AS outcome, count(*) AS n FROM x GROUP BY ALL""")
def example_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive and negative examples of fields, scored, by outcome."""
    e = load(spark, sf_dir, "embeddings").withColumn("field", F.col("label") % 3)
    scored = lambda i: e.select("field", F.round(50 + 200 * F.col("embedding")[i].cast("double"), 4).alias("score"))
    return records.examples(scored(0), scored(1), 60.0).groupBy("field", "label", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH e AS ({_EX}) SELECT field, count(*) AS n, round(count(*) FILTER (other >= 60) / count(*), 4) AS baseline_support, round(count(*) FILTER (score >= 60) / count(*), 4) AS support, round((count(*) FILTER (score >= 60) - count(*) FILTER (other >= 60)) / count(*), 4) AS delta FROM e GROUP BY field")
def positive_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda i: F.round(50 + 200 * F.col("embedding")[i].cast("double"), 4)
    e = load(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("field"), F.lit(1).alias("label"), s(0).alias("score"), s(1).alias("baseline"))
    return records.positive_support(e, "field", 60.0)


@query("""SELECT o_custkey, string_agg(o_orderpriority || ' ' || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) AS body, string_agg(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ' ' || o_orderkey END, chr(10) || chr(10) ORDER BY o_orderkey) AS one FROM orders GROUP BY o_custkey""")
def engine_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of an application joined by blank lines, and those of one engine (a status)."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("t"))
    joined = lambda c: F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), "\n\n"), F.lit(""))
    here = F.struct("o_orderkey", "t")
    return o.groupBy("o_custkey").agg(joined(here).alias("body"), joined(F.when(F.col("o_orderstatus") == "F", here)).alias("one"))


_TERMS = "[" + ", ".join("[" + ", ".join(f"'{t}'" for t in ts) + "]" for ts in rc.UNIT_TERMS.values()) + "]"
_SET = "list_distinct(list_filter(string_split(lower(trim(regexp_replace({0}, '[^a-zA-Z0-9]+', ' ', 'g'))), ' '), lambda x: x <> ''))"
_NODES = f"""SELECT p_partkey, p_size % 20 AS graph, p_size || ' mL' AS expected, p_name || ' ' || (p_size + p_partkey % 2) || CASE p_partkey % 4 WHEN 0 THEN ' ml' WHEN 1 THEN ' fluid ounces' WHEN 2 THEN '' ELSE ' GALLON' END AS seen, round((p_partkey % 50) / 50.0, 4) AS similarity, (p_partkey % 10) / 10.0 AS confidence, p_partkey % 4 AS panel FROM part"""
_RANKED = f"""SELECT *, len(list_intersect({_SET.format('expected')}, {_SET.format('seen')})) / len({_SET.format('expected')}) AS share,
  CASE WHEN len(list_filter({_TERMS}, lambda ts: len(list_filter(ts, lambda t: contains(lower(trim(regexp_replace(expected, '[^a-zA-Z0-9]+', ' ', 'g'))), t))) > 0 AND len(list_filter(ts, lambda t: contains(lower(trim(regexp_replace(seen, '[^a-zA-Z0-9]+', ' ', 'g'))), t))) > 0)) > 0 THEN 1.0 ELSE 0.0 END AS unit,
  CASE WHEN contains(lower(trim(regexp_replace(seen, '[^a-zA-Z0-9]+', ' ', 'g'))), regexp_extract(expected, '[0-9]+')) THEN 1.0 ELSE 0.0 END AS number FROM ({_NODES})"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    unit = picked([" ml", " fluid ounces", "", " GALLON"], k % 4)
    return p.select(
        "p_partkey", (F.col("p_size") % 20).alias("graph"), F.concat(F.col("p_size").cast("string"), F.lit(" mL")).alias("expected"), F.concat("p_name", F.lit(" "), (F.col("p_size") + k % 2).cast("string"), unit).alias("seen"),
        F.round((k % 50) / 50.0, 4).alias("similarity"), ((k % 10) / 10.0).alias("confidence"), (k % 4).alias("panel"),
    )


@query(f"SELECT p_partkey, graph, round(share, 6) AS share, unit, number, round(similarity + 0.25 * share + 0.2 * unit + 0.15 * number + 0.05 * confidence, 6) AS rank FROM ({_RANKED})")
def node_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a recognised block (a part's name and size) says of what is expected."""
    n, want, seen = _nodes(spark, sf_dir), F.col("expected"), F.col("seen")
    return n.select("p_partkey", "graph", F.round(overlap(want, seen), 6).alias("share"), rc.unit_match(want, seen).alias("unit"), rc.number_hit(want, seen).alias("number"), F.round(rc.node_rank(F.col("similarity"), want, seen, F.col("confidence")), 6).alias("rank"))


@query(f"WITH r AS (SELECT p_partkey, graph, similarity + confidence AS rank FROM ({_NODES})), t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY graph ORDER BY rank DESC, p_partkey) <= 6) SELECT graph, p_partkey, CAST(row_number() OVER (PARTITION BY graph ORDER BY p_partkey) AS INT) AS place FROM t")
def top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.top_nodes(_nodes(spark, sf_dir), "graph", F.col("similarity") + F.col("confidence"), "p_partkey", 6).select("graph", "p_partkey", "place")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY similarity DESC) AS k FROM ({_NODES})) SELECT graph, max(similarity) AS best, round(avg(similarity) FILTER (k <= 3), 6) AS top3, round(avg(similarity) FILTER (k <= 8), 6) AS top8, max(confidence) AS most_confident, round(avg(confidence), 6) AS mean_confidence,
  least(count(*), 256) / 256.0 AS size, least(count(DISTINCT panel), 10) / 10.0 AS panels, least(count(*) FILTER (similarity >= 0.8), 10) / 10.0 AS high FROM r GROUP BY graph""")
def graph_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.graph_summary(_nodes(spark, sf_dir), "graph")
