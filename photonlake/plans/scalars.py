"""Queries over scalar functions, upkeep of tables, accounts and ranking measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.functions import paths, scores, text, times
from photonlake.operators import accounts, folders, maintenance, matching, people
from photonlake.operators.ordering import resort_hits
from photonlake.plans import adapters as A
from photonlake.plans.browse import EVENTS, ORDERS
from photonlake.session import load
from photonlake.sources.files import fingerprint
from photonlake.sources.sinks import export_names

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _r6(c):
    return scores.round_to(c, 6)


@query(
    f"""SELECT id, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '/([^/]+)$', 1) AS name, len(string_split(path, '/')) - 1 AS depth, string_split(path, '/')[2] AS child,
  path LIKE '/ASIA/%' AS in_asia FROM {ORDERS}"""
)
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return A.order_photos(spark, d).select("id", paths.parent_dir(p).alias("parent"), paths.folder_name(p).alias("name"), F.size(paths.ancestors(p)).cast("long").alias("depth"), paths.child_of(p, "/").alias("child"), paths.in_dir(p, F.lit("/ASIA/")).alias("in_asia"))


@query(f"SELECT id, CASE WHEN taken_at > 0 THEN strftime(make_timestamp(taken_at * 1000000), '%Y-%m-%d') ELSE '----------' END AS day, CASE WHEN taken_at <> 0 THEN strftime(make_timestamp(taken_at * 1000000), '%B %Y') ELSE '' END AS month FROM {ORDERS}")
def time_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.order_photos(spark, d).select("id", times.taken_label(F.col("taken_at")).alias("day"), times.month_label(F.col("taken_at")).alias("month"))


@query("SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS at FROM orders")
def exif_times(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(".25")))
    return o.select(F.col("o_orderkey").alias("id"), times.exif_time(written).alias("at"))


_M = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 50 AS b, l_discount / 2 AS hi, l_tax AS lo, l_quantity % 7 / 7 AS dr, (l_partkey % 300) / 20.0 AS cast_s, l_suppkey % 5 = 0 AS mono, l_extendedprice % 9 AS noise, 1 + l_tax * 10 AS blocky, l_extendedprice % 101 AS rating, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity % 10 END AS aes FROM lineitem)"
_E = "greatest(0, least(1, 1 - (4 * greatest(0, hi - 0.01) + 2 * greatest(0, lo - 0.04)) - (greatest(0, 0.25 - b) * 4 + greatest(0, b - 0.75) * 4) - greatest(0, 0.5 - dr) * 0.8))"
_C = "CASE WHEN mono THEN 1.0 ELSE 1 - greatest(0, least(1, (cast_s - 3) / 9)) END"
_T = "rating * (1 - 0.1 * (1 - e)) * (1 - 0.1 * (1 - c)) * (1 - 0.2 * greatest(0, least(1, (blocky - 1.15) / 0.85)))"


@query(
    f"""SELECT id, round(max(e) * 1e6) / 1e6 AS exposure, round(max(c) * 1e6) / 1e6 AS color, round(max(1 - greatest(0, least(1, (noise - 1.5) / 5.5))) * 1e6) / 1e6 AS noise_score, round(max({_T}) * 1e6) / 1e6 AS technical,
  round(max(CASE WHEN aes IS NULL THEN {_T} ELSE round((0.5 * {_T} + 0.5 * greatest(0, least(1, (aes - 3) / 5)) * 100) * 10) / 10 END) * 1e4) / 1e4 AS overall FROM (SELECT *, {_E} AS e, {_C} AS c FROM {_M}) GROUP BY id"""
)
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    c = F.col
    m = li.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"),
        scores.exposure_score(c("l_quantity") / 50, c("l_discount") / 2, c("l_tax"), c("l_quantity") % 7 / 7).alias("e"),
        scores.color_score((c("l_partkey") % 300) / 20.0, c("l_suppkey") % 5 == 0).alias("c"),
        scores.noise_score(c("l_extendedprice") % 9).alias("n"),
        (1 + c("l_tax") * 10).alias("blocky"),
        (c("l_extendedprice") % 101).alias("rating"),
        F.when(c("l_linenumber") % 3 != 0, c("l_quantity") % 10).alias("aes"),
    )
    t = scores.technical(c("rating"), c("e"), c("c"), c("blocky"))
    out = m.withColumn("t", t).withColumn("o", scores.overall(c("t"), c("aes")))
    return out.groupBy("id").agg(_r6(F.max("e")).alias("exposure"), _r6(F.max("c")).alias("color"), _r6(F.max("n")).alias("noise_score"), _r6(F.max("t")).alias("technical"), scores.round_to(F.max("o"), 4).alias("overall"))


@query(
    """SELECT vec_id AS id, CASE WHEN 20 * abs(embedding[3]) < 3 THEN 'neutral' WHEN g >= 45 AND g < 135 THEN 'warm/yellow' WHEN g >= -45 AND g < 45 THEN 'magenta' WHEN g >= -135 AND g < -45 THEN 'cool/blue' ELSE 'green' END AS label
FROM (SELECT *, degrees(atan2(CAST(embedding[2] AS DOUBLE), CAST(embedding[1] AS DOUBLE))) AS g FROM embeddings)"""
)
def cast_labels(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return A.vectors(spark, d).select("id", scores.cast_label(v[0].cast("double"), v[1].cast("double"), 20 * F.abs(v[2])).alias("label"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, max(concat_ws(',', CASE WHEN l_quantity / 50 < 0.3 THEN 'soft' END, CASE WHEN l_discount * 10 < 0.5 THEN 'exposure' END, CASE WHEN l_tax < 0.02 AND l_linenumber % 2 <> 0 THEN 'cast' END, CASE WHEN l_tax * 20 > 1.5 THEN 'jpeg' END)) AS badges FROM lineitem GROUP BY 1")
def quality_badges(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    b = scores.badges(c("l_quantity") / 50, c("l_discount") * 10, c("l_tax") * 5, c("l_linenumber") % 2 == 0, c("l_tax") * 20)
    return load(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.array_join(b, ",").alias("b")).groupBy("id").agg(F.max("b").alias("badges"))


_MODEL = scores.RatingModel(["s", "p"], ["p"], [10.0, 7.0], [5.0, 0.5], [[0, 0], [1, 0], [0, 1], [2, 0], [1, 1], [0, 2]], [1.0, 0.1, 0.2, 0.9, 0.3, 0.8], [1.0, 1.1, 1.2, 1.3, 1.4, 1.5], [0.0, 0.11, 0.07, -0.05, 0.03, 0.02], 0.5)


@query(
    """SELECT p_partkey AS id, round(100 * greatest(0, least(1, 0.5 + 0.11 * (x - 0.1) / 1.1 + 0.07 * (y - 0.2) / 1.2 - 0.05 * (x * x - 0.9) / 1.3 + 0.03 * (x * y - 0.3) / 1.4 + 0.02 * (y * y - 0.8) / 1.5)) * 1e6) / 1e6 AS rating
FROM (SELECT p_partkey, (p_size - 10.0) / 5 AS x, (ln(1 + p_retailprice) - 7) / 0.5 AS y FROM part)"""
)
def quadratic_rating(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("p"))
    return p.select("id", _r6(_MODEL.column()).alias("rating"))


@query("SELECT p_partkey AS id, regexp_replace(left(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 40), '[-.]+$', '') AS slug, trim(p_brand || ' ' || p_type) AS camera FROM part")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), text.model_slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), text.camera_label(F.col("p_brand"), F.col("p_type")).alias("camera"))


_LIB = "(SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '/p/L.photoslibrary/originals/' WHEN 1 THEN '/p/L.photoslibrary/resources/' WHEN 2 THEN '/p/CaptureOne/' WHEN 3 THEN '/p/.hid/' ELSE '/p/ok/' END || doc_id || '.jpg' AS path FROM documents)"


@query(f"SELECT id, path LIKE '%.photoslibrary/resources/%' OR path LIKE '%/CaptureOne/%' AS cache, path LIKE '%.photoslibrary/resources/%' OR path LIKE '%/CaptureOne/%' OR path LIKE '%/.hid/%' AS excluded, CASE WHEN path LIKE '%.photoslibrary/%' THEN '/p/L.photoslibrary' ELSE '' END AS lib FROM {_LIB}")
def library_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    folder = F.when(k == 0, "/p/L.photoslibrary/originals/").when(k == 1, "/p/L.photoslibrary/resources/").when(k == 2, "/p/CaptureOne/").when(k == 3, "/p/.hid/").otherwise("/p/ok/")
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(folder, F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    p = F.col("path")
    return rows.select("id", paths.in_app_cache(p).alias("cache"), paths.excluded(p).alias("excluded"), paths.library_parts(p)["lib"].alias("lib"))


@query("SELECT doc_id AS id, substr(sha256(unhex(printf('%02x%02x%02x%02x00000000', n & 255, (n >> 8) & 255, (n >> 16) & 255, (n >> 24) & 255)) || encode(text)), 1, 32) AS fingerprint FROM (SELECT *, octet_length(encode(text)) AS n FROM documents)")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), fingerprint(F.octet_length(content), content).alias("fingerprint"))


@query(
    """WITH f AS (SELECT doc_id AS id, '/n/' || doc_id AS path, md5(text) AS fp FROM documents WHERE doc_id % 2 = 0), k AS (SELECT md5(text) AS fp, '/o/' || doc_id AS old_path, doc_id % 3 <> 0 AS alive FROM documents WHERE doc_id % 2 = 1),
b AS (SELECT fp, arg_min(old_path, (alive, old_path)) AS old_path, min(alive) AS alive FROM k GROUP BY fp)
SELECT path, CASE WHEN b.fp IS NULL THEN 'new' WHEN alive THEN 'copied' ELSE 'moved' END AS kind, old_path FROM f LEFT JOIN b USING (fp)"""
)
def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("fingerprint"), F.lit(1).cast("long").alias("size"))
    found = docs.filter("doc_id % 2 = 0").select("fingerprint", "size", F.concat(F.lit("/n/"), F.col("doc_id").cast("string")).alias("path"))
    known = docs.filter("doc_id % 2 = 1").select("fingerprint", "size", F.concat(F.lit("/o/"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 3 != 0).alias("exists"))
    return matching.classify_files(found, known).select("path", "kind", "old_path")


@query("SELECT d.doc_id AS id, min(o.doc_id) AS twin FROM documents d JOIN documents o ON md5(d.text) = md5(o.text) AND o.doc_id % 4 <> 0 WHERE d.doc_id % 4 = 0 GROUP BY 1")
def live_twins(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("fingerprint"))
    return maintenance.live_twin(p.filter("id % 4 = 0"), p)


@query("SELECT event_id AS photo_id, event_type AS tag FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, 'new' FROM events WHERE event_id % 5 = 0 AND event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 5 = 0 AND event_id % 2 = 1")
def replaced_tags(spark: SparkSession, d: str) -> DataFrame:
    t = A.event_tags(spark, d)
    return maintenance.replace_tags(t, t.filter("photo_id % 10 = 0").withColumn("tag", F.lit("new")))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS stack_top, o_custkey % 3 <> 0 AS stacked FROM orders WHERE o_custkey > 0")
def unhidden_frames(spark: SparkSession, d: str) -> DataFrame:
    """Tops are customers; every third is gone, and its frames show again."""
    o = load(spark, d, "orders").filter("o_custkey > 0").select((F.col("o_orderkey") + 10_000_000).alias("id"), F.col("o_custkey").alias("stack_top"), F.lit(True).alias("stacked"), F.lit(2).cast("long").alias("stack_size"))
    tops = load(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("stack_top"), F.lit(False).alias("stacked"), F.lit(2).cast("long").alias("stack_size"))
    return maintenance.unhide_orphans(o.unionByName(tops)).filter("id >= 10000000").select((F.col("id") - 10_000_000).alias("id"), "stack_top", "stacked")


@query(f"SELECT '0' AS a, path, lpad(CAST(row_number() OVER (ORDER BY overall DESC NULLS LAST, id) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (ORDER BY overall DESC NULLS LAST, id) AS VARCHAR))) AS INTEGER), '0') || '_' || id || '.jpg' AS target FROM {ORDERS}")
def export_targets(spark: SparkSession, d: str) -> DataFrame:
    p = A.order_photos(spark, d)
    return export_names(p, [F.col("overall").desc_nulls_last(), F.col("id")]).select(F.lit("0").alias("a"), "path", "target")


@query(f"SELECT id, overall, source FROM (SELECT * FROM {EVENTS} ORDER BY overall DESC, id LIMIT 40) ORDER BY source, id")
def resorted_hits(spark: SparkSession, d: str) -> DataFrame:
    p = A.event_photos(spark, d).select("id", "overall", "source", F.col("overall").alias("score"))
    return resort_hits(p, 40, [F.col("source"), F.col("id")]).drop("score")


@query("SELECT DISTINCT doc_id AS id FROM documents WHERE source = 'src1' UNION SELECT doc_id FROM labels WHERE quality = 0")
def union_ids(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "documents").filter("source = 'src1'").select(F.col("doc_id").alias("id"))
    return a.union(load(spark, d, "labels").filter("quality = 0").select("doc_id")).distinct()


@query("SELECT o_orderkey AS photo_id, coalesce(l_linenumber, 0) AS face FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey WHERE o_orderkey > 500")
def changed_faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces of changed photos; a photo without any reports face 0."""
    o = maintenance.changed_since(load(spark, d, "orders").select(F.col("o_orderkey").alias("photo_id")), 500, "photo_id")
    f = load(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("photo_id"), "l_linenumber")
    return o.join(f, "photo_id", "left").select("photo_id", F.coalesce("l_linenumber", F.lit(0)).alias("face"))


@query("SELECT count(DISTINCT vec_id // 2) AS photos, count(*) >= 200 AS at_least FROM (SELECT vec_id FROM embeddings ORDER BY embedding[1] DESC, vec_id LIMIT 200)")
def distinct_photos(spark: SparkSession, d: str) -> DataFrame:
    hits = A.face_rows(spark, d).orderBy(F.col("embedding")[0].desc(), "id").limit(200)
    return people.distinct_photos(hits, 200)


@query(
    f"""WITH r AS (SELECT * FROM (VALUES ('/ASIA'), ('/ASIA/NATION_12'), ('/')) AS v(root)) SELECT path, arg_max(root, length(root)) AS root FROM {ORDERS} JOIN r ON root = '/' OR path = root OR starts_with(path, root || '/') GROUP BY path"""
)
def deepest_roots(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([("/ASIA",), ("/ASIA/NATION_12",), ("/",)], "path string")
    return folders.deepest_root(A.order_photos(spark, d).select("path"), roots)


@query("SELECT c_custkey AS id, c_name, count(o_orderkey) AS sessions FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1996-01-01' GROUP BY 1, 2")
def users_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.unix_timestamp("o_orderdate").alias("expires_at"))
    return accounts.users_with_sessions(load(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), s, times.year_start(1996))


@query(
    """WITH r AS (SELECT label, row_number() OVER (PARTITION BY label % 3 ORDER BY embedding[1] DESC, vec_id) AS k, label % 3 AS q, (label = 3 OR label = 4 OR label = 5) AS hit FROM embeddings),
p AS (SELECT q, k, hit, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY k) AS hits FROM r)
SELECT CAST(q AS INTEGER) AS query, round(sum(CASE WHEN hit THEN hits / k ELSE 0 END) / sum(CASE WHEN hit THEN 1 ELSE 0 END) * 1e6) / 1e6 AS ap, max(CASE WHEN k = 10 THEN hits END) / 10.0 AS p_at_10 FROM p GROUP BY q"""
)
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    from photonlake.operators.training import ranking_quality

    v = A.vectors(spark, d)
    ranked = v.select((F.col("label") % 3).alias("query"), F.col("label").isin(3, 4, 5).alias("hit"), F.row_number().over(W.partitionBy(F.col("label") % 3).orderBy(F.col("embedding")[0].desc(), "id")).alias("rank"))
    return ranking_quality(ranked, 10).select("query", _r6(F.col("ap")).alias("ap"), "p_at_10")
