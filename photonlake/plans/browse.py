"""Queries over filters, orders, pages, joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.functions.scores import round_to
from photonlake.functions.text import contains_literal
from photonlake.operators import people, scoring, training
from photonlake.operators.filters import Filter, Related, apply_filter, filter_count, matching_ids, visible_frames
from photonlake.operators.ordering import page, photo_order
from photonlake.plans import adapters as A
from photonlake.session import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EVENTS = "(SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS taken_at, 'u' || user_id AS camera_model, value AS overall, CAST(event_id % 4 AS INTEGER) AS source, event_type FROM events)"
ORDERS = """(SELECT o_orderkey AS id, '/' || r_name || '/' || n_name || '/' || c_mktsegment || '/' || o_orderkey || '.jpg' AS path,
  CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS taken_at,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS overall, CAST(o_orderkey % 4 AS INTEGER) AS source, CAST(o_custkey % 4 AS INTEGER) AS face_count
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Embeddings as frames with the two halves of their perceptual hash.
HASHES = """h AS (SELECT vec_id AS id, label, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding[1:32], lambda x: CASE WHEN CAST(x AS DOUBLE) > m THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END)), lambda a, x: a * 2 + x) AS hi,
  list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding[33:64], lambda x: CASE WHEN CAST(x AS DOUBLE) > m THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END)), lambda a, x: a * 2 + x) AS lo
  FROM (SELECT *, list_median(CAST(embedding AS DOUBLE[])) AS m FROM embeddings))"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"SELECT id, taken_at, overall FROM {EVENTS} WHERE event_type = 'purchase' AND overall >= 10 AND taken_at >= 1704067200 AND taken_at < 1735689600 AND taken_at <> 0 ORDER BY overall DESC, id LIMIT 21")
def browse_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    f = Filter(min_overall=10, tag="purchase", year=2024, limit=20)
    hits = apply_filter(A.event_photos(spark, d), f, Related(tags=A.event_tags(spark, d)))
    return page(hits.select("id", "taken_at", "overall"), photo_order(f.sort), f.limit)


def _sorted(name: str, columns: str, sql_order: str, sort: str):
    @query(f"SELECT {columns} FROM {ORDERS} ORDER BY {sql_order} LIMIT 51")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return page(A.order_photos(spark, d).select(*columns.split(", ")), photo_order(sort), 50)

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_sorted("browse_sort_worst", "id, overall", "overall ASC NULLS FIRST, id", "worst")
_sorted("browse_sort_newest", "id, taken_at", "taken_at DESC, id", "newest")
_sorted("browse_sort_oldest", "id, taken_at", "(taken_at > 0) DESC, taken_at ASC, id", "oldest")
_sorted("browse_sort_faces", "id, face_count, overall", "face_count DESC, overall DESC NULLS LAST, id", "faces")
_sorted("browse_sort_path", "id, path", "path, id", "path")


@query(f"SELECT id, overall FROM {ORDERS} WHERE source <> 3 ORDER BY overall DESC NULLS LAST, id LIMIT 31 OFFSET 60")
def browse_page_offset(spark: SparkSession, d: str) -> DataFrame:
    return page(apply_filter(A.order_photos(spark, d), Filter(source="photos")).select("id", "overall"), photo_order("overall"), 30, 60)


@query(r"SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) LIKE '%red\_%' ESCAPE '\' OR lower(p_brand) LIKE '%and#1%' ESCAPE '\'")
def filter_text_literal(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return p.filter(contains_literal(F.col("p_name"), "Red_") | contains_literal(F.col("p_brand"), "AND#1")).select("p_partkey", "p_name", "p_brand")


@query(f"SELECT id, taken_at FROM {ORDERS} WHERE taken_at >= epoch(TIMESTAMP '1994-01-01') AND taken_at < epoch(TIMESTAMP '1996-01-01') AND taken_at <> 0")
def filter_year_range(spark: SparkSession, d: str) -> DataFrame:
    return apply_filter(A.order_photos(spark, d), Filter(year_from=1995, year_to=1994)).select("id", "taken_at")


@query(f"SELECT id FROM {ORDERS} WHERE taken_at < epoch(TIMESTAMP '1993-01-01')")
def filter_until_keeps_undated(spark: SparkSession, d: str) -> DataFrame:
    return apply_filter(A.order_photos(spark, d), Filter(time_to=725846400)).select("id")


@query(f"SELECT id, path FROM {ORDERS} WHERE (path >= '/ASIA/NATION_1/' AND path < '/ASIA/NATION_10') OR (path >= '/EUROPE/' AND path < '/EUROPE0')")
def filter_subtree(spark: SparkSession, d: str) -> DataFrame:
    return apply_filter(A.order_photos(spark, d), Filter(dirs=("/ASIA/NATION_1", "/EUROPE/"))).select("id", "path")


@query(f"SELECT id, face_count FROM {ORDERS} WHERE face_count >= 3 AND source = 1 AND overall >= 50000")
def filter_faces_source(spark: SparkSession, d: str) -> DataFrame:
    return apply_filter(A.order_photos(spark, d), Filter(faces="group", source="camera", min_overall=50000.0)).select("id", "face_count")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)")
def filter_semi_person(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000))
    return load(spark, d, "customer").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def filter_anti_unscored(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"SELECT event_id AS id FROM events WHERE event_id % 50 = 0 AND event_id IN (SELECT id FROM {EVENTS} WHERE overall >= 20 AND source <> 3)")
def filter_membership(spark: SparkSession, d: str) -> DataFrame:
    p = A.event_photos(spark, d)
    return matching_ids(p, p.filter("id % 50 = 0").select("id"), Filter(min_overall=20, source="photos"))


@query(
    """WITH s AS (SELECT doc_id AS id, n_chars, min(doc_id) OVER (PARTITION BY md5(text)) AS top, count(*) OVER (PARTITION BY md5(text)) AS n, source FROM documents),
  p AS (SELECT id, n_chars, source, CASE WHEN n > 1 THEN top ELSE 0 END AS stack_top, n > 1 AND id <> top AS stacked FROM s)
SELECT id, stack_top, stacked FROM p WHERE source <> 'src3' AND (NOT stacked OR NOT EXISTS (SELECT 1 FROM p t WHERE t.source <> 'src3' AND t.id = p.stack_top))"""
)
def stacked_visibility(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.md5(F.col("text").cast("binary")).alias("h"))
    tops = docs.groupBy("h").agg(F.min("id").alias("top"), F.count("*").alias("n"))
    p = docs.join(tops, "h").select("id", "source", F.when(F.col("n") > 1, F.col("top")).otherwise(0).alias("stack_top"), ((F.col("n") > 1) & (F.col("id") != F.col("top"))).alias("stacked"))
    return visible_frames(p.filter("source <> 'src3'")).select("id", "stack_top", "stacked")


@query("SELECT (SELECT count(*) FROM documents) AS photos, (SELECT count(*) FROM embeddings) AS faces, (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM labels WHERE quality = 1) AS labelled, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors")
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [("photos", load(spark, d, "documents")), ("faces", load(spark, d, "embeddings")), ("people", load(spark, d, "customer")), ("labelled", load(spark, d, "labels").filter("quality = 1")), ("errors", load(spark, d, "events").filter("event_type = 'error'"))]
    rows = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("k") == name, F.col("n"))).alias(name) for name, _ in parts])


@query(f"SELECT count(*) AS n FROM {EVENTS} WHERE source <> 3")
def filter_count_photos(spark: SparkSession, d: str) -> DataFrame:
    return filter_count(A.event_photos(spark, d), Filter(source="photos"))


@query("SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.event_tags(spark, d).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


@query(f"SELECT DISTINCT CAST(year(make_timestamp(taken_at * 1000000)) AS INTEGER) AS year FROM {ORDERS} WHERE taken_at <> 0 AND year(make_timestamp(taken_at * 1000000)) >= 1800 ORDER BY 1")
def years_distinct(spark: SparkSession, d: str) -> DataFrame:
    from photonlake.functions.times import taken_year

    y = A.order_photos(spark, d).select(taken_year(F.col("taken_at")).alias("year")).distinct()
    return y.filter("year >= 1800 and year <= year(current_date()) + 1").orderBy("year")


@query(
    """SELECT c_custkey AS id, c_name AS name, count(DISTINCT l_orderkey) AS photos, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS manual_photos,
  count(l_orderkey) AS faces, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0)::BIGINT AS manual_faces
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def person_conditional_distinct(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    li = load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")
    faces = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.monotonically_increasing_id().alias("id"), F.col("l_orderkey").alias("photo_id"), F.col("o_custkey").alias("person_id"), F.when(F.col("l_returnflag") == "R", "manual").alias("person_source"), F.lit(1.0).alias("width_px"), F.lit(1.0).alias("score"), F.lit(0.0).alias("yaw")
    )
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return people.person_counts(c, faces).drop("best_face")


@query("SELECT s_suppkey AS id, s_name AS name, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l WHERE l.l_suppkey = s_suppkey) AS scored FROM supplier")
def model_scored_counts(spark: SparkSession, d: str) -> DataFrame:
    scores = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("model")).distinct()
    return scoring.scored_counts(load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), scores)


@query(
    """SELECT conv_id AS photo_id, role AS rater, turn AS id, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY (length(text) > 100) DESC, turn DESC) AS k FROM conversations) WHERE k = 1"""
)
def latest_feedback(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations").select(F.col("conv_id").alias("photo_id"), F.col("role").alias("rater"), F.col("turn").alias("id"), F.length("text").cast("long").alias("n"))
    rows = c.withColumn("rating", F.when(F.col("n") > 100, F.col("n")))
    return people.latest_by_priority(rows, ["photo_id", "rater"], "rating").drop("rating")


@query("SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query("SELECT person, best_face FROM (SELECT o_custkey AS person, o_orderkey AS best_face, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_face_per_person(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    best = F.max(F.struct((F.col("o_orderstatus") == "F").alias("m"), F.col("o_totalprice").alias("q"), (-F.col("o_orderkey")).alias("neg")))
    return o.groupBy(F.col("o_custkey").alias("person")).agg(best.alias("b")).select("person", (-F.col("b.neg")).alias("best_face"))


@query(
    """WITH s AS (SELECT l_orderkey AS photo_id, l_returnflag AS model, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2), m AS (SELECT * FROM (VALUES ('A', 0.5), ('R', 1.5)) AS v(model, weight))
SELECT photo_id, round(sum(weight * score) / sum(weight) * 1e6) / 1e6 AS blend FROM s JOIN m USING (model) GROUP BY photo_id"""
)
def weighted_blend(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("photo_id"), F.col("l_returnflag").alias("model")).agg(F.max("l_quantity").alias("score"))
    models = spark.createDataFrame([("A", 0.5, True), ("R", 1.5, True), ("N", 1.0, False)], "id string, weight double, active boolean")
    return scoring.blend(s, models).withColumn("blend", round_to(F.col("blend"), 6))


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS b FROM part)
SELECT round(corr(a, b) * 1e6) / 1e6 AS rho FROM r"""
)
def spearman_corr(spark: SparkSession, d: str) -> DataFrame:
    return training.spearman_column(load(spark, d, "part"), "p_retailprice", "p_size").select(round_to(F.col("rho"), 6).alias("rho"))


@query(
    """WITH e AS (SELECT (l_discount * 100 - l_tax * 100) * (l_discount * 100 - l_tax * 100) AS e, l_quantity AS c FROM lineitem), m AS (SELECT sum(c * e) / sum(c) AS m, sum(c) AS w, count(*) AS n FROM e)
SELECT round(m * 1e4) / 1e4 AS mse, round(sqrt(m) * 1e4) / 1e4 AS rmse, round((SELECT sqrt(sum(c * c * (e - m) * (e - m))) FROM e) / w * sqrt(n / (n - 1.0)) * 1e4) / 1e4 AS se FROM m"""
)
def weighted_error(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    out = training.weighted_error(li, F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity"))
    return out.select(*[round_to(F.col(c), 4).alias(c) for c in ("mse", "rmse", "se")])


@query("SELECT o_custkey AS key, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def rank_hits(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rank"))


@query("SELECT user_id, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') GROUP BY 1")
def sliding_failures(spark: SparkSession, d: str) -> DataFrame:
    from photonlake.operators.accounts import recent_failures

    rows = load(spark, d, "events").filter("event_type = 'error'").select("user_id", F.unix_timestamp("ts").alias("at"))
    return recent_failures(rows, ["user_id"], 86400).groupBy("user_id").agg(F.max("failures").alias("most"))
