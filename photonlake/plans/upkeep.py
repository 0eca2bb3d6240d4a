"""Queries over label, model, library and account tables, and the streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.operators import accounts, maintenance, matching, people, scoring
from photonlake.plans import adapters as A
from photonlake.plans.groups import BURST_GAP
from photonlake.session import load, scratch_path
from photonlake.streaming import sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_FACES = "(SELECT vec_id AS id, vec_id // 2 AS photo_id, CASE WHEN vec_id % 5 = 0 THEN CAST(label AS BIGINT) WHEN vec_id % 5 = 1 THEN CAST(label + 1 AS BIGINT) END AS person_id, CASE WHEN vec_id % 5 = 0 THEN 'manual' WHEN vec_id % 5 = 1 THEN 'auto' END AS person_source FROM embeddings)"


def _faces(spark: SparkSession, d: str) -> DataFrame:
    f = A.face_rows(spark, d)
    auto = F.col("id") % 5 == 1
    label = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    f = f.join(label, "id")
    return f.withColumn("person_id", F.when(auto, F.col("label").cast("long") + 1).otherwise(F.col("person_id"))).withColumn("person_source", F.when(auto, "auto").otherwise(F.col("person_source"))).drop("label")


def _named() -> list:
    """Person and source, unnamed faces as -1 and empty."""
    return [F.coalesce("person_id", F.lit(-1)).alias("person_id"), F.coalesce("person_source", F.lit("")).alias("person_source")]


@query(f"SELECT id, CASE WHEN person_source = 'manual' THEN person_id WHEN id % 4 = 0 THEN 3 ELSE -1 END AS person_id, CASE WHEN person_source = 'manual' THEN 'manual' WHEN id % 4 = 0 THEN 'auto' ELSE '' END AS person_source FROM {_FACES}")
def applied_labels(spark: SparkSession, d: str) -> DataFrame:
    f = _faces(spark, d)
    new = f.filter("id % 4 = 0").select("id", F.lit(3).cast("long").alias("person_id"), F.lit(0.5).alias("sim"))
    return people.apply_labels(f, new).select("id", *_named())


@query(f"SELECT id, CASE WHEN person_id = 2 THEN 7 ELSE coalesce(person_id, -1) END AS person_id FROM {_FACES}")
def merged_person(spark: SparkSession, d: str) -> DataFrame:
    """Renaming a person to a name that another has moves all faces there."""
    p = spark.createDataFrame([(i, f"Person {i}", 0) for i in range(12)], "id long, name string, created_at long")
    return people.rename_person(p, _faces(spark, d), 2, "PERSON 7")[1].select("id", _named()[0])


@query(f"SELECT id, CASE WHEN id % 9 = 0 THEN 5 ELSE coalesce(person_id, -1) END AS person_id, CASE WHEN id % 9 = 0 THEN 'manual' ELSE coalesce(person_source, '') END AS person_source FROM {_FACES}")
def assigned_faces(spark: SparkSession, d: str) -> DataFrame:
    f = _faces(spark, d)
    return people.assign(f, f.filter("id % 9 = 0").select("id"), 5).select("id", *_named())


@query(f"SELECT photo_id, count(*) FILTER (WHERE s >= 0.6) AS face_count, max(w) AS width_px FROM (SELECT photo_id, 0.6 + (id % 40) / 100.0 AS s, 40.0 + id % 120 AS w FROM {_FACES}) GROUP BY 1")
def confident_faces(spark: SparkSession, d: str) -> DataFrame:
    f = A.face_rows(spark, d).withColumn("sharpness", F.col("width_px"))
    return people.confident_faces(f).select("photo_id", "face_count", "width_px")


@query("SELECT o_orderkey AS photo_id, 'old' AS model, o_totalprice AS score FROM orders WHERE o_orderkey % 5 <> 0")
def adopted_scores(spark: SparkSession, d: str) -> DataFrame:
    p = A.order_photos(spark, d).select("id", F.col("overall").alias("aesthetic"))
    have = p.filter("id % 10 = 1 and aesthetic is not null").select(F.col("id").alias("photo_id"), F.lit("old").alias("model"), F.col("aesthetic").alias("score"))
    return scoring.adopt_scores(p, have, "old")


_U = "upper(substr(md5(text), 1, 8) || '-' || substr(md5(text), 9, 4) || '-' || substr(md5(text), 13, 4) || '-' || substr(md5(text), 17, 4) || '-' || substr(md5(text), 21, 12))"


@query(f"WITH f AS (SELECT doc_id AS id, {_U} AS u FROM documents) SELECT c.id, arg_min(o.id, '/L/originals/' || o.id || '/' || o.u) AS original FROM f c JOIN f o ON c.u = o.u AND o.id % 2 = 0 WHERE c.id % 2 = 1 GROUP BY c.id")
def library_originals(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("text").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    f = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/L/originals/"), F.col("doc_id").cast("string"), F.lit("/"), F.upper(uuid)).alias("path"))
    return matching.library_originals(f.filter("id % 2 = 1"), f.filter("id % 2 = 0"))


@query("SELECT page_id AS id, page_id % 3 = 0 OR page_id % 5 = 0 AS apple_shot, CASE WHEN page_id % 3 = 0 OR page_id % 5 = 0 THEN 3 ELSE 1 END AS source FROM pages")
def marked_screenshots(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.lit(1).alias("source"), (F.col("page_id") % 5 == 0).alias("apple_shot"))
    return maintenance.mark_screenshots(p, p.filter("id % 3 = 0").select("path")).select("id", "apple_shot", "source")


@query("SELECT url AS path, page_id AS at FROM pages ORDER BY page_id DESC, url LIMIT 20")
def recent_errors(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("at"))
    return maintenance.recent(e, 20)


@query("SELECT o_orderkey AS token FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate > TIMESTAMP '1997-01-01'")
def usable_invites(spark: SparkSession, d: str) -> DataFrame:
    inv = load(spark, d, "orders").select(F.col("o_orderkey").alias("token"), F.unix_timestamp("o_orderdate").alias("expires_at"), F.when(F.col("o_orderkey") % 3 == 0, 1).alias("used_at"))
    return accounts.usable_invites(inv, 852076800).select("token")


@query("SELECT '/p/' || o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE -1 END AS old_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE) END AS aesthetic FROM orders")
def saved_photos(spark: SparkSession, d: str) -> DataFrame:
    """Photos saved again keep their ids, and their rating where the content is the same; the others are new."""
    o = load(spark, d, "orders")
    key = F.col("o_orderkey")
    base = [F.concat(F.lit("/p/"), key.cast("string")).alias("path"), F.lit(None).cast("double").alias("overall"), F.lit(0).alias("source"), F.lit(False).alias("apple_shot"), F.lit(0).cast("long").alias("seq")]
    old = o.filter("o_orderkey % 2 = 0").select((key + 1).alias("id"), *base, F.col("o_custkey").cast("double").alias("aesthetic"), F.lit("a").alias("fingerprint"))
    new = o.select(F.lit(None).cast("long").alias("id"), *base, F.lit(None).cast("double").alias("aesthetic"), F.when(key % 3 == 0, "a").otherwise("b").alias("fingerprint"))
    n = F.substring("path", 4, 20).cast("long")
    return maintenance.save_photos(old, new, 1).select("path", F.when(n % 2 == 0, F.col("id")).otherwise(-1).alias("old_id"), "aesthetic")


@query(
    f"""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {BURST_GAP} SECOND THEN 1 ELSE 0 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
SELECT user_id, min(event_id) AS burst_id, count(*) AS size, max(value) AS best FROM r GROUP BY user_id, run"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The events as a file stream; every trigger rewrites the table of all sessions so far."""
    events = load(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = scratch_path(spark, "sessions")
    table = sessions.batch_bursts(stream, "user_id", "ts", f"{BURST_GAP} seconds").select("user_id", "burst_id", "size", "best")
    run = table.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True)
    run.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(table.schema).parquet(out)
