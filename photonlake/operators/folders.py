"""Folder trees in path strings: roll-ups over all ancestors, best photo per folder, breadcrumbs and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.functions.paths import ancestors, folder_name, parent_dir, trim_dir
from photonlake.operators.ordering import photo_order
from photonlake.schemas import SOURCE_MEME

#: A meme covers a folder only when nothing else does.
MEME_PENALTY = 1000.0


def rollup(photos: DataFrame) -> DataFrame:
    """One row per folder above some photo: counts, cover, newest time and scores of everything below.

    The cover is the highest score (none counts as 0, memes 1000 less), then the lowest id; the newest time
    leaves out undated photos and is 0 when all are. Partial aggregation keeps the root from being a hot task."""
    score = F.coalesce("overall", F.lit(0.0)) - F.when(F.col("source") == SOURCE_MEME, MEME_PENALTY).otherwise(0.0)
    rows = photos.select("id", "taken_at", "overall", "source", score.alias("_score"), F.explode(ancestors(F.col("path"))).alias("folder"))
    out = rows.groupBy(F.col("folder").alias("path")).agg(
        F.count("*").alias("total"),
        F.max(F.struct(F.col("_score").alias("s"), (-F.col("id")).alias("neg"))).alias("_cover"),
        F.coalesce(F.max(F.when(F.col("taken_at") != 0, F.col("taken_at"))), F.lit(0)).alias("newest_at"),
        F.count("overall").alias("scored"),
        F.coalesce(F.sum("overall"), F.lit(0.0)).alias("score_sum"),
        F.count_if(F.col("source") == SOURCE_MEME).alias("memes"),
    )
    return out.withColumn("parent", parent_dir(F.col("path"))).withColumn("cover_id", -F.col("_cover.neg")).withColumn("cover_overall", F.col("_cover.s")).drop("_cover")


def average_score(score_sum: Column, scored: Column) -> Column:
    """Mean score; null when nothing is scored."""
    return F.try_divide(score_sum, scored)


def merge_folders(folders: DataFrame, key: str) -> DataFrame:
    """Fold several folders' figures into one row per key."""
    out = folders.groupBy(key).agg(
        F.sum("total").alias("total"),
        F.max(F.struct(F.col("cover_overall").alias("s"), (-F.col("cover_id")).alias("neg"))).alias("_cover"),
        F.coalesce(F.max(F.when(F.col("newest_at") != 0, F.col("newest_at"))), F.lit(0)).alias("newest_at"),
        F.sum("scored").alias("scored"),
        F.sum("score_sum").alias("score_sum"),
        F.sum("memes").alias("memes"),
    )
    return out.withColumn("cover_id", -F.col("_cover.neg")).withColumn("cover_overall", F.col("_cover.s")).drop("_cover")


def photos_in_groups(photos: DataFrame, groups: DataFrame) -> DataFrame:
    """Photos with the groups (grp, dir) that hold them, by exploded ancestors; a photo may be in several groups, and comes
    once for each folder of a group that is above it."""
    dirs = groups.select("grp", trim_dir(F.col("dir")).alias("_dir")).distinct()
    opened = photos.withColumn("_dir", F.explode(ancestors(F.col("path"))))
    return opened.join(dirs, "_dir").drop("_dir")


def best_per_group(photos: DataFrame, groups: DataFrame, sort: str = "overall") -> DataFrame:
    """The photo that sorts first in every group; groups without photos have none. Tasks keep the first of each group
    before the shuffle, so photos that come twice cost nothing more."""
    best = W.partitionBy("grp").orderBy(*photo_order(sort))
    return photos_in_groups(photos, groups).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def subfolders(folders: DataFrame, parent: str) -> DataFrame:
    return folders.filter(F.col("parent") == parent).orderBy(F.lower(folder_name(F.col("path"))), "path")


def card_order(sort: str) -> list[Column]:
    """Albums by name, by newest photo (undated last) or by mean score (unscored last)."""
    name = [F.lower(folder_name(F.col("path"))).asc(), F.col("path").asc()]
    if sort == "newest":
        return [(F.col("newest_at") == 0).asc(), F.col("newest_at").desc(), *name]
    if sort == "score":
        return [average_score(F.col("score_sum"), F.col("scored")).desc_nulls_last(), *name]
    return name


def outermost(paths: DataFrame) -> DataFrame:
    """Paths that lie in no other of the set."""
    inner = paths.select("path", F.explode(ancestors(F.col("path"))).alias("_up")).join(paths.select(F.col("path").alias("_up")), "_up").select("path").distinct()
    return paths.join(inner, "path", "left_anti")


def deepest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """For every path the longest root that is the path or above it (null when none)."""
    steps = paths.select("path", F.explode(F.array_union(ancestors(F.col("path")), F.array("path"))).alias("_up"))
    found = steps.join(roots.select(F.col("path").alias("_up")), "_up").groupBy("path").agg(F.max_by("_up", F.length("_up")).alias("root"))
    return paths.join(found, "path", "left")


def breadcrumbs(path: Column, root: Column) -> Column:
    """Folders from the root down to the path, both included."""
    return F.filter(F.array_union(ancestors(path), F.array(path)), lambda x: F.length(x) >= F.length(root))


def missing_by_folder(listing: DataFrame) -> DataFrame:
    """(path, missing) -> per direct folder: how many of its photos are missing, and all."""
    return listing.groupBy(parent_dir(F.col("path")).alias("folder")).agg(F.count_if("missing").alias("missing"), F.count("*").alias("total"))
