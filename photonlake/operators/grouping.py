"""Stacks of alike frames, duplicate sets, group summaries and pages, and the whole regrouping job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.operators.grouped import map_whole_groups
from photonlake.operators.ordering import group_order, page
from photonlake.operators.sessions import pack_chunks, scenes_and_bursts
from photonlake.schemas import GROUP_BURST, GROUP_DUPLICATE, SOURCE_MEME


def bit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def stack_frames(frames: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """keys, id, stack_top, stack_size, stacked of the frames in stacks of two or more.

    Best first (overall, then lower id), an unassigned frame takes every later unassigned one within ``bits`` of its own
    hash; hash 0 is none. The order decides, so a chunk (bounded by the packing) is worked through in one piece."""
    schema = frames.select(*keys, "id").schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def work(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        hashes, all_ids = pdf["phash"].to_numpy(np.int64).view(np.uint64), pdf["id"].to_numpy()
        top, size = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            h, ids, free = hashes[a:b], all_ids[a:b], np.ones(b - a, dtype=bool)
            for i in range(b - a):
                if not free[i]:
                    continue
                near = np.flatnonzero(free[i:] & (bit_distance(h[i:], h[i]) <= bits)) + i
                if len(near) > 1:
                    top[a + near], size[a + near] = ids[i], len(near)
                    free[near] = False
        out = pdf[[*keys, "id"]].assign(stack_top=top, stack_size=size, stacked=(top != all_ids) & (top != 0))
        return out[size > 0]

    wanted = frames.select(*dict.fromkeys([*keys, "id", "overall", "phash"])).filter("phash is not null and phash <> 0")
    best_first = [F.col("overall").desc_nulls_last(), F.col("id").asc()]
    return map_whole_groups(wanted, keys, best_first, work, f"{kinds}, stack_top long, stack_size long, stacked boolean")


def duplicate_sets(photos: DataFrame, hash_col: str = "phash") -> DataFrame:
    """id, dup_id of photos whose hash (not 0, not null) two or more share; the set is named by its lowest id."""
    some = photos.filter(F.col(hash_col).isNotNull() & (F.col(hash_col).cast("string") != "0"))
    sets = some.groupBy(hash_col).agg(F.min("id").alias("dup_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return some.join(sets, hash_col).select("id", "dup_id")


def group_summary(members: DataFrame, keys: list[str], list_members: bool = True) -> DataFrame:
    """One row per group: what a page of groups sorts and shows by. Maxima start at 0; times span undated members too,
    the oldest time leaves them out (0 when all are); pairs are compared left to right.

    ``list_members`` gathers the ids of a group in one row; leave it off where groups may be huge (the photos carry
    their group's id anyway)."""
    floor = lambda c: F.greatest(F.lit(0.0), F.max(c))
    best = F.max(F.struct(F.col("overall"), (-F.col("id")).alias("neg"), F.col("camera")))
    focus = F.max(F.struct(F.col("focus_score").alias("a"), F.col("sharpness").alias("b")))
    faces = F.max(F.struct(F.col("face_count").alias("a"), F.col("overall").alias("b")))
    out = members.groupBy(*keys).agg(
        F.count("*").alias("size"),
        F.min("taken_at").alias("start_at"),
        F.max("taken_at").alias("end_at"),
        F.coalesce(F.min(F.when(F.col("taken_at") != 0, F.col("taken_at"))), F.lit(0)).alias("oldest_at"),
        best.alias("_best"),
        F.min("overall").alias("min_overall"),
        floor("technical").alias("max_technical"),
        floor("aesthetic").alias("max_aesthetic"),
        focus.alias("_focus"),
        floor("colorfulness").alias("max_colorful"),
        faces.alias("_faces"),
        F.count_if(F.col("source") == SOURCE_MEME).alias("memes"),
        *([F.array_sort(F.collect_list("id")).alias("members")] if list_members else []),
    )
    return (
        out.withColumn("best_id", -F.col("_best.neg"))
        .withColumn("best_overall", F.col("_best.overall"))
        .withColumn("camera", F.col("_best.camera"))
        .withColumn("max_focus", F.greatest(F.lit(0.0), F.col("_focus.a")))
        .withColumn("focus_sharp", F.greatest(F.lit(0.0), F.col("_focus.b")))
        .withColumn("max_faces", F.greatest(F.lit(0), F.col("_faces.a")))
        .withColumn("faces_overall", F.greatest(F.lit(0.0), F.col("_faces.b")))
        .drop("_best", "_focus", "_faces")
    )


def group_page(groups: DataFrame, memberships: DataFrame, matching: DataFrame | None, sort: str, min_size: int, limit: int, offset: int = 0) -> DataFrame:
    """A page of groups of at least min_size members, of those with a matching member (id) when a filter is on."""
    wanted = groups.filter(F.col("size") >= min_size)
    if matching is not None:
        hit = memberships.join(matching.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select("id").distinct()
        wanted = wanted.join(hit, "id", "left_semi")
    return page(wanted, group_order(sort), limit, offset)


def group_members(memberships: DataFrame, photos: DataFrame, group_id: Column | int) -> DataFrame:
    """A group's photos, best first."""
    ids = memberships.filter(F.col("id") == group_id).select(F.col("photo_id").alias("id"))
    return photos.join(ids, "id", "left_semi").orderBy(F.col("overall").desc_nulls_last(), F.col("id"))


def stack_members(photos: DataFrame, top: int) -> DataFrame:
    return photos.filter(F.col("stack_top") == top).orderBy(F.col("overall").desc_nulls_last(), F.col("id"))


def regroup(photos: DataFrame, burst_gap: float = 3, stack_bits: int = 10, scene_gap: float = 600, chunk_limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(photo columns, groups): scenes, bursts, chunks, stacks, duplicate sets and both kinds of group rows."""
    plain = photos.drop("burst_id", "stack_top", "stack_size", "stacked", "dup_id")
    filled = plain.withColumn("camera_make", F.coalesce("camera_make", F.lit(""))).withColumn("camera_model", F.coalesce("camera_model", F.lit("")))
    keys = ["camera_make", "camera_model"]
    frames = pack_chunks(scenes_and_bursts(filled, keys, burst_gap, scene_gap), keys, chunk_limit).select(*keys, "scene", "chunk", "id", "burst_id", "overall", "phash")
    frames = frames.persist(StorageLevel.DISK_ONLY)  # read for the bursts and for the stacks
    stacks = stack_frames(frames.filter("chunk >= 0"), [*keys, "scene", "chunk"], stack_bits).select("id", "stack_top", "stack_size", "stacked")
    sets = duplicate_sets(filled)
    columns = (
        filled.select("id")
        .join(frames.select("id", "burst_id"), "id", "left")
        .join(stacks, "id", "left")
        .join(sets, "id", "left")
        .select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("burst_id", "stack_top", "stack_size")), F.coalesce("stacked", F.lit(False)).alias("stacked"), F.coalesce("dup_id", F.lit(0)).alias("dup_id"))
    )
    filled = filled.withColumn("camera", F.trim(F.concat_ws(" ", "camera_make", "camera_model")))
    both = columns.select("id", F.explode(F.array(F.struct(F.lit(GROUP_BURST).alias("kind"), F.col("burst_id").alias("g")), F.struct(F.lit(GROUP_DUPLICATE).alias("kind"), F.col("dup_id").alias("g")))).alias("x")).filter("x.g <> 0")
    groups = group_summary(filled.join(both.select("id", "x.*"), "id"), ["kind", "g"]).withColumnRenamed("g", "id")
    return columns, groups


def first_per_stack(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Of every stack only the hit that ranks first; photos outside stacks all stay."""
    key = F.when(F.coalesce("stack_top", F.lit(0)) != 0, F.col("stack_top")).otherwise(-F.col("id") - 1)
    best = W.partitionBy("_stack").orderBy(rank)
    return hits.withColumn("_stack", key).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_stack", "_n")
