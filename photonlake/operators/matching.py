"""Matching joins: twins of copies, boxes by overlap, fingerprints, greedy suppression."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.functions.paths import library_parts, original_uuid
from photonlake.functions.vectors import hamming
from photonlake.operators.grouped import map_whole_groups


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 when they only touch."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def box(alias: str) -> list[Column]:
    return [F.col(f"{alias}.{c}") for c in ("x1", "y1", "x2", "y2")]


def twins(copies: DataFrame, originals: DataFrame, max_bits: int = 10, seconds: int = 1) -> DataFrame:
    """(id, twin): the photo that each copy was made from, where that is certain.

    Equal hash first: a single one is the twin; of several, the single one of the same camera within a second; else none.
    Without an equal hash: of the same camera's photos within a second and ``max_bits``, the one nearest by bits and then
    time, unless two are equally near. The band join is an equi-join on camera and neighbouring time buckets; equal hashes
    are counted before they are listed, so a hash that thousands share is never paired."""
    c = copies.select("id", "phash", F.coalesce("taken_at", F.lit(0)).alias("at"), F.coalesce("camera_make", F.lit("")).alias("make"), F.coalesce("camera_model", F.lit("")).alias("model"))
    o = originals.select(F.col("id").alias("oid"), F.col("phash").alias("ophash"), F.coalesce("taken_at", F.lit(0)).alias("oat"), F.coalesce("camera_make", F.lit("")).alias("omake"), F.coalesce("camera_model", F.lit("")).alias("omodel"))
    hashed = c.filter("phash is not null and phash <> 0")
    per_hash = o.filter("ophash <> 0").groupBy("ophash").agg(F.count("*").alias("n"), F.min("oid").alias("one"), F.max("oid").alias("two"))
    counted = hashed.join(per_hash, hashed["phash"] == per_hash["ophash"], "left")
    # The copy itself may be among the originals of its hash.
    self_in = counted.join(o.select(F.col("oid").alias("_self"), F.col("ophash").alias("_sh")), (F.col("id") == F.col("_self")) & (F.col("phash") == F.col("_sh")), "left")
    counted = self_in.withColumn("_n", F.coalesce("n", F.lit(0)) - F.col("_self").isNotNull().cast("int"))
    one = F.when(F.col("one") == F.col("id"), F.col("two")).otherwise(F.col("one"))
    single = counted.filter("_n = 1").select("id", F.when(F.col("n") == 1, F.col("one")).otherwise(one).alias("twin"))

    def near(side: DataFrame) -> DataFrame:
        """Pairs of one camera within the seconds: time buckets of the copy's own width and its two neighbours."""
        width = seconds + 1
        left = side.filter("model <> '' and at <> 0").withColumn("_b", F.explode(F.array(*[F.floor(F.col("at") / width) + d for d in (-1, 0, 1)])))
        right = o.withColumn("_b", F.floor(F.col("oat") / width))
        on = (left["_b"] == right["_b"]) & (left["make"] == right["omake"]) & (left["model"] == right["omodel"]) & (left["id"] != right["oid"]) & (F.abs(left["at"] - right["oat"]) <= seconds)
        return left.join(right, on)

    several = near(counted.filter("_n > 1").select("id", "phash", "at", "make", "model")).filter("phash = ophash")
    several = several.groupBy("id").agg(F.count("*").alias("k"), F.min("oid").alias("twin")).filter("k = 1").select("id", "twin")
    close = near(counted.filter("_n = 0").select("id", "phash", "at", "make", "model")).filter("ophash <> 0")
    close = close.withColumn("bits", hamming(F.col("phash"), F.col("ophash"))).filter(F.col("bits") <= max_bits)
    rank = W.partitionBy("id").orderBy("bits", F.abs(F.col("at") - F.col("oat")), "oid")
    close = close.withColumn("_n", F.rank().over(W.partitionBy("id").orderBy("bits", F.abs(F.col("at") - F.col("oat"))))).withColumn("_k", F.row_number().over(rank)).filter("_n = 1")
    close = close.groupBy("id").agg(F.count("*").alias("k"), F.min("oid").alias("twin")).filter("k = 1").select("id", "twin")
    return single.unionByName(several).unionByName(close)


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """Pairs of equal keys whose times differ by at most ``width``: the left side is listed in three buckets of
    that width, so the join is an equi-join whatever the length of the series. Columns come back as l and r structs."""
    a = left.select(*keys, F.struct(*left.columns).alias("l"), F.explode(F.array(*[F.floor(F.col(at) / width) + d for d in (-1, 0, 1)])).alias("_b"))
    b = right.select(*keys, F.struct(*right.columns).alias("r"), F.floor(F.col(at) / width).alias("_b"))
    return a.join(b, [*keys, "_b"]).filter(F.abs(F.col(f"l.{at}") - F.col(f"r.{at}")) <= width).select("l", "r")


def hash_segments(n: int, max_bits: int) -> tuple[int, int]:
    """(segments, bits they may differ by) for pairs of 64-bit hashes within ``max_bits``: of m segments one differs by at
    most max_bits // m bits. Few long segments prune most, many short ones list fewest codes; the cheaper shape by count."""

    def cost(m: int) -> float:
        codes = sum(math.comb(64 // m, r) for r in range(max_bits // m + 1))
        return m * codes * n + m * codes * float(n) ** 2 / 2 ** (64 // m)

    m = min(range(1, max_bits + 2), key=lambda k: cost(k) if max_bits // k <= 3 else math.inf)
    return m, max_bits // m


def near_hashes(frames: DataFrame, keys: list[str], max_bits: int, id_col: str = "id", hash_col: str = "phash") -> DataFrame:
    """keys, a, b, bits: pairs a < b of equal keys whose 64-bit hashes differ by at most ``max_bits``.

    An equi-join on segments of the hash: one side lists every code within reach of its segments, the other its own, so
    the pairs tested are those that agree on a stretch and not all of a key. A pair counts at its first such segment."""
    m, reach = hash_segments(frames.count(), max_bits)
    edges = [64 * i // m for i in range(m + 1)]

    def segment(h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1 if edges[i + 1] - edges[i] < 64 else -1))

    def within(i: int) -> list[int]:
        bits = range(edges[i + 1] - edges[i])
        return [sum(1 << b for b in some) for r in range(reach + 1) for some in itertools.combinations(bits, r)]

    rows = frames.select(*keys, F.col(id_col).alias("a"), F.col(hash_col).alias("h"))
    h = F.col("h")
    own = F.array(*[F.struct(F.lit(i).alias("i"), segment(h, i).alias("code")) for i in range(m)])

    def reachable(i: int) -> Column:
        return F.transform(F.lit(within(i)).cast("array<long>"), lambda d: F.struct(F.lit(i).alias("i"), segment(h, i).bitwiseXOR(d).alias("code")))

    near = F.concat(*[reachable(i) for i in range(m)])
    left = rows.select(*keys, "a", "h", F.explode(near).alias("s")).select(*keys, "a", "h", "s.*")
    right = rows.select(*keys, F.col("a").alias("b"), F.col("h").alias("h2"), F.explode(own).alias("s")).select(*keys, "b", "h2", "s.*")
    met = left.join(right, [*keys, "i", "code"]).filter("a < b")
    other = F.col("h2")
    earlier = F.lit(False)
    for i in range(m - 1):
        earlier = earlier | ((F.col("i") > i) & (hamming(segment(h, i), segment(other, i)) <= reach))
    return met.withColumn("bits", hamming(h, other).cast("int")).filter((F.col("bits") <= max_bits) & ~earlier).select(*keys, "a", "b", "bits")


def carry_labels(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(photo_id, old_id, new_id, iou): each old face named by hand and the new face it overlaps most, over ``least``.
    A new face may be hit twice; ties go to the lower id."""
    pairs = old.filter(F.col("person_source") == "manual").alias("o").join(new.alias("n"), F.col("o.photo_id") == F.col("n.photo_id"))
    scored = pairs.select(F.col("o.photo_id").alias("photo_id"), F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"), overlap(box("o"), box("n")).alias("iou")).filter(F.col("iou") > least)
    best = W.partitionBy("old_id").orderBy(F.col("iou").desc(), F.col("new_id").asc())
    return scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def move_labels(pairs: DataFrame, faces: DataFrame, least: float = 0.5) -> DataFrame:
    """(face_id, person_id): faces of an original that take the names given by hand on its copies (pairs: copy, original).
    In the order of the copies and their faces every face takes the free face it overlaps most, by at least ``least``; the
    later of equals."""
    sides = [faces.join(pairs, F.col("photo_id") == F.col("copy")), faces.join(pairs.select("original").distinct().withColumn("copy", F.lit(None).cast("long")), F.col("photo_id") == F.col("original"))]
    wanted = [side.select("original", "copy", "id", "x1", "y1", "x2", "y2", "person_id", (F.coalesce("person_source", F.lit("")) == "manual").alias("by_hand")) for side in sides]

    def work(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        corners, person = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["person_id"].to_numpy(float)
        by_hand, on_copy, ids = pdf["by_hand"].to_numpy(bool), pdf["copy"].notna().to_numpy(), pdf["id"].to_numpy()
        named = on_copy & by_hand & ~np.isnan(person)
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            free = np.flatnonzero(~on_copy[a:b] & ~by_hand[a:b]) + a
            for f in np.flatnonzero(named[a:b]) + a:
                if not len(free):
                    break
                share = box_overlap(corners[free], corners[f])
                at = len(share) - 1 - int(share[::-1].argmax())
                if share[at] >= least:
                    out.append((ids[free[at]], int(person[f])))
                    free = np.delete(free, at)
        return pd.DataFrame(out, columns=["face_id", "person_id"])

    return map_whole_groups(wanted[0].unionByName(wanted[1]), ["original"], [F.col("copy").asc_nulls_last(), F.col("id")], work, "face_id long, person_id long")


def box_overlap(boxes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Intersection over union of many boxes with one."""
    w = np.clip(np.minimum(boxes[:, 2], one[2]) - np.maximum(boxes[:, 0], one[0]), 0, None)
    h = np.clip(np.minimum(boxes[:, 3], one[3]) - np.maximum(boxes[:, 1], one[1]), 0, None)
    union = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) + (one[2] - one[0]) * (one[3] - one[1]) - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


def keep_boxes(boxes: np.ndarray, scores: np.ndarray, limit: float) -> np.ndarray:
    """Row numbers that greedy suppression keeps, best first; boxes are inclusive pixels."""
    order = np.argsort(-scores, kind="stable")
    area = (boxes[:, 2] - boxes[:, 0] + 1) * (boxes[:, 3] - boxes[:, 1] + 1)
    kept = []
    while len(order):
        i, order = order[0], order[1:]
        kept.append(i)
        w = np.minimum(boxes[i, 2], boxes[order, 2]) - np.maximum(boxes[i, 0], boxes[order, 0]) + 1
        h = np.minimum(boxes[i, 3], boxes[order, 3]) - np.maximum(boxes[i, 1], boxes[order, 1]) + 1
        both = np.where((w > 0) & (h > 0), w * h, 0)
        order = order[both / (area[i] + area[order] - both) <= limit]
    return np.array(kept, dtype=int)


def suppress(boxes: DataFrame, limit: float = 0.4) -> DataFrame:
    """Boxes (photo_id, id, x1 .. y2, score) without those that a better one of the photo covers."""

    def work(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        corners, scores = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["score"].to_numpy(float)
        ends = np.append(starts[1:], len(pdf))
        return pdf.iloc[np.concatenate([a + keep_boxes(corners[a:b], scores[a:b], limit) for a, b in zip(starts, ends, strict=True)])]

    wanted = boxes.select("photo_id", "id", "x1", "y1", "x2", "y2", "score")
    return map_whole_groups(wanted, ["photo_id"], ["id"], work, wanted.schema)


def classify_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """New files as moved, copied or new: an equal fingerprint and size whose old path is gone was moved."""
    old = known.select("fingerprint", "size", F.col("path").alias("old_path"), F.col("exists").alias("old_exists"))
    hit = listing.join(old, ["fingerprint", "size"], "left").filter("old_path is null or old_path <> path")
    best = W.partitionBy("path").orderBy(F.col("old_exists").asc_nulls_last(), F.col("old_path").asc_nulls_last())
    first = hit.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return first.withColumn("kind", F.when(F.col("old_path").isNull(), "new").when(F.col("old_exists"), "copied").otherwise("moved"))


def library_originals(copies: DataFrame, originals: DataFrame) -> DataFrame:
    """(id, original): a library's copy and the original of that library that carries its UUID; the lowest path of several."""
    keyed = lambda rows: rows.withColumn("_u", original_uuid(F.col("path"))).withColumn("_lib", library_parts(F.col("path"))["lib"]).filter("_u <> ''")
    b = keyed(originals).groupBy("_lib", "_u").agg(F.min_by("id", "path").alias("original"))
    return keyed(copies).join(b, ["_lib", "_u"]).select("id", "original")
