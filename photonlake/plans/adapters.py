"""The driver's tables read as entities of the catalogue (what stands for what is in the README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions.vectors import median_hash
from photonlake.session import load


def event_photos(spark: SparkSession, d: str) -> DataFrame:
    """events as photos: time, camera (user), overall (value); tags are the event types."""
    e = load(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.unix_timestamp(F.date_trunc("second", "ts")).alias("taken_at"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("camera_model"),
        F.lit("cam").alias("camera_make"),
        F.col("value").alias("overall"),
        (F.col("event_id") % 4).cast("int").alias("source"),
        "event_type",
    )


def event_tags(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_id").alias("photo_id"), F.col("event_type").alias("tag"))


def event_groups(spark: SparkSession, d: str) -> DataFrame:
    """events with the columns that group summaries read."""
    p = event_photos(spark, d)
    v = F.col("overall")
    return p.select(
        "id", "taken_at", "camera_make", "camera_model", "overall", "source", F.col("camera_model").alias("camera"),
        (v * 2).alias("technical"), (v % 10).alias("aesthetic"), F.floor(v % 7).cast("double").alias("focus_score"), (v % 3).alias("sharpness"), (v % 11).alias("colorfulness"), (F.col("id") % 5).cast("int").alias("face_count"),
    )


def order_photos(spark: SparkSession, d: str) -> DataFrame:
    """orders as photos in a folder tree /region/nation/segment/customer; every tenth is undated, every fifth unscored."""
    o, c, n, r = (load(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit("/"), F.col("c_mktsegment"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"),
        F.when(F.col("o_orderkey") % 10 == 0, 0).otherwise(F.unix_timestamp("o_orderdate")).alias("taken_at"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("overall"),
        (F.col("o_orderkey") % 4).cast("int").alias("source"),
        (F.col("o_custkey") % 4).cast("int").alias("face_count"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as frames with a 64-bit perceptual hash; the overall score repeats, so that ties decide."""
    v = vectors(spark, d)
    return v.select("id", "label", median_hash(F.col("embedding")).alias("phash"), (F.col("id") * 7 % 20).cast("double").alias("overall"))


def face_rows(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as faces: every fifth is named by hand with its label, two faces to a photo."""
    known = F.col("id") % 5 == 0
    return vectors(spark, d).select(
        "id", F.floor(F.col("id") / 2).cast("long").alias("photo_id"), "embedding",
        F.when(known, F.col("label").cast("long")).alias("person_id"), F.when(known, "manual").alias("person_source"), F.lit(None).cast("double").alias("person_sim"),
        (40 + F.col("id") % 120).cast("double").alias("width_px"), (0.6 + (F.col("id") % 40) / 100.0).alias("score"), ((F.col("id") % 13) / 10.0 - 0.6).alias("yaw"),
    )


def query_vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    """One stored vector as the numbers of a query, as a caller would send them."""
    return [float(x) for x in load(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]
