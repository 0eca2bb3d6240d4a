"""Orders with explicit null placement and an id tie-break, and pages over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def photo_order(sort: str) -> list[Column]:
    """Sort keys of a page of photos; an unknown name sorts by overall."""
    c = F.col
    keys = {
        "technical": [c("technical").desc_nulls_last()],
        "aesthetic": [c("aesthetic").desc_nulls_last()],
        "sharpness": [c("focus_score").desc_nulls_last(), c("sharpness").desc_nulls_last()],
        "newest": [c("taken_at").desc_nulls_last()],
        "oldest": [(c("taken_at") > 0).desc_nulls_last(), c("taken_at").asc_nulls_last()],
        "colorful": [c("colorfulness").desc_nulls_last()],
        "faces": [c("face_count").desc_nulls_last(), c("overall").desc_nulls_last()],
        "worst": [c("overall").asc_nulls_first()],
        "path": [c("path").asc_nulls_first()],
    }.get(sort, [c("overall").desc_nulls_last()])
    return [*keys, c("id").asc()]


def group_order(sort: str) -> list[Column]:
    """Sort keys of a page of groups; ties show the newer group id first."""
    c = F.col
    keys = {
        "worst": [c("min_overall").asc_nulls_first()],
        "newest": [c("end_at").desc_nulls_last()],
        "oldest": [(c("oldest_at") == 0).asc_nulls_first(), c("oldest_at").asc_nulls_first()],
        "technical": [c("max_technical").desc_nulls_last()],
        "aesthetic": [c("max_aesthetic").desc_nulls_last()],
        "sharpness": [c("max_focus").desc_nulls_last(), c("focus_sharp").desc_nulls_last()],
        "colorful": [c("max_colorful").desc_nulls_last()],
        "faces": [c("max_faces").desc_nulls_last(), c("faces_overall").desc_nulls_last()],
    }.get(sort, [c("best_overall").desc_nulls_last()])
    return [*keys, c("id").desc()]


def page(df: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit of the order, and one more that tells whether there is a next page."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit + 1) if limit else ordered


def split_page(rows: list, limit: int) -> tuple[list, bool]:
    """The page itself and whether more rows follow."""
    return rows[:limit], len(rows) > limit


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    from pyspark.sql.window import Window as W

    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def resort_hits(hits: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Re-sort within the best k hits (columns score, id)."""
    return hits.orderBy(F.col("score").desc(), F.col("id").asc()).limit(k).orderBy(*order)


def dense_number(df: DataFrame, keys: list[str], out: str, buckets: int = 256) -> DataFrame:
    """Number the rows 0, 1, .. without a global sort: hash buckets are counted, and rows are numbered in their own."""
    from pyspark.sql.window import Window as W

    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = F.coalesce(F.sum("count").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = rows.groupBy("_bucket").count().select("_bucket", before.alias("_base"))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*keys)) - 1
    return rows.join(base, "_bucket").withColumn(out, (F.col("_base") + inside).cast("long")).drop("_bucket", "_base")


def ordered_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number the rows 1, 2, .. in an order (which must decide all ties) without a single task: ranges are sorted, counted
    and numbered each by itself."""
    from pyspark import StorageLevel
    from pyspark.sql.window import Window as W

    rows = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    before = F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = rows.groupBy("_part").count().select("_part", before.alias("_base"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return rows.join(base, "_part").withColumn(out, (F.col("_base") + inside).cast("long")).drop("_part", "_base")
