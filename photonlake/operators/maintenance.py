"""Upkeep of the tables: upserts, diffs, pruning, labels and stars moved to twins, conditional updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from photonlake.functions.paths import in_app_cache, parent_dir
from photonlake.operators.folders import missing_by_folder
from photonlake.operators.ordering import dense_number
from photonlake.schemas import SOURCE_MEME


def changed_since(rows: DataFrame, mark: int, seq: str = "seq") -> DataFrame:
    """Rows of a later change number than the reader's mark."""
    return rows.filter(F.col(seq) > mark)


def unchanged(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files to read: those not known with the same path, size and time."""
    return listing.join(known.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced by new ones of the same key, and the others of both."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def save_photos(photos: DataFrame, results: DataFrame, first_seq: int) -> DataFrame:
    """Upsert by path: ids and scores stay where the content is the same; every saved row gets a new change number."""
    old = photos.select("path", F.col("id").alias("_id"), F.col("fingerprint").alias("_fp"), F.col("aesthetic").alias("_aes"), F.col("overall").alias("_ovr"), F.col("apple_shot").alias("_shot"))
    top = photos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    joined = dense_number(results.join(old, "path", "left"), ["path"], "_nth")
    fresh = dense_number(joined.filter("_id is null").select("path"), ["path"], "_new")
    joined = joined.join(fresh, "path", "left")
    same = F.col("_fp") == F.col("fingerprint")
    out = joined.withColumns(
        {
            "id": F.coalesce("_id", top + F.col("_new") + 1).cast("long"),
            "seq": (F.lit(first_seq) + F.col("_nth")).cast("long"),
            "aesthetic": F.when(same, F.coalesce("aesthetic", "_aes")).otherwise(F.col("aesthetic")),
            "overall": F.when(same & F.col("aesthetic").isNull() & F.col("_aes").isNotNull(), F.col("_ovr")).otherwise(F.col("overall")),
            "source": F.when(F.coalesce("_shot", F.lit(False)), F.lit(SOURCE_MEME)).otherwise(F.col("source")),
            "apple_shot": F.coalesce("_shot", F.lit(False)),
        }
    ).drop("_id", "_fp", "_aes", "_ovr", "_shot", "_nth", "_new")
    return upsert(photos, out.select(*photos.columns), ["path"])


def diff_rows(stored: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change (insert, update, delete) of the rows that a write has to touch."""
    values = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, F.struct(*values).alias("_old"))
    b = computed.select(*keys, F.struct(*values).alias("_new"))
    j = a.join(b, keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    return j.select(*keys, change.alias("change")).filter("change is not null")


def gone_keys(stored: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return stored.select(key).join(kept.select(key), key, "left_anti").distinct()


def prune(photos: DataFrame, listing: DataFrame, personal: DataFrame | None = None, empty_folders: DataFrame | None = None, force: bool = False) -> DataFrame:
    """(path, fate) of catalogued files that the listing lacks: gone, held (all of a folder is missing and the folder is gone
    or empty, as when a drive is offline) or spared (an application's copy that carries something personal)."""
    state = photos.select("id", "path").join(listing.select("path", F.lit(True).alias("_there")), "path", "left").withColumn("missing", F.col("_there").isNull())
    per = missing_by_folder(state).withColumnRenamed("missing", "n_missing")
    rows = state.filter("missing").withColumn("folder", parent_dir(F.col("path"))).join(per, "folder")
    if empty_folders is None:
        offline = F.lit(True)
    else:
        rows = rows.join(empty_folders.select(F.col("path").alias("folder"), F.lit(True).alias("_empty")), "folder", "left")
        offline = F.col("_empty").isNotNull()
    held = (F.col("n_missing") == F.col("total")) & offline & F.lit(not force)
    if personal is not None:
        rows = rows.join(personal.select("id").distinct().withColumn("_mine", F.lit(True)), "id", "left")
        spared = in_app_cache(F.col("path")) & F.col("_mine").isNotNull()
    else:
        spared = F.lit(False)
    return rows.select("id", "path", F.when(held, "held").when(spared, "spared").otherwise("gone").alias("fate"))


def personal_photos(faces: DataFrame, feedback: DataFrame, stars: DataFrame) -> DataFrame:
    """Ids of photos that carry a face named by hand, a judgement or a star."""
    return faces.filter(F.col("person_source") == "manual").select(F.col("photo_id").alias("id")).union(feedback.select("photo_id")).union(stars.select("photo_id")).distinct()


def prune_allowed(roots_ready: bool, gaps: int) -> None:
    """Refuse to prune after a run that could not see everything."""
    if not roots_ready:
        raise RuntimeError("a root is not reachable; nothing is pruned")
    if gaps:
        raise RuntimeError(f"{gaps} folders could not be read; nothing is pruned")


def live_twin(gone: DataFrame, photos: DataFrame) -> DataFrame:
    """(id, twin): for photos that go, the lowest id left with the same full fingerprint (32 digits)."""
    left = photos.join(gone.select("id"), "id", "left_anti").filter(F.length("fingerprint") == 32).groupBy("fingerprint").agg(F.min("id").alias("twin"))
    return photos.join(gone.select("id"), "id", "left_semi").join(left, "fingerprint").select("id", "twin")


def move_rows(rows: DataFrame, twins: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """Rows (photo_id, ..) rewritten to their photo's twin; one of each ``unique`` key stays, the oldest owner's first."""
    moved = rows.join(twins.select(F.col("id").alias("photo_id"), "twin"), "photo_id", "left")
    out = moved.withColumn("_own", F.col("twin").isNull()).withColumn("photo_id", F.coalesce("twin", "photo_id"))
    if unique:
        best = W.partitionBy(*unique).orderBy(F.col("_own").desc())
        out = out.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return out.select(*rows.columns)


def replace_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """All tags of the photos in new are replaced."""
    return tags.join(new.select("photo_id").distinct(), "photo_id", "left_anti").unionByName(new)


def update_if_current(rows: DataFrame, updates: DataFrame, columns: list[str], condition: Column | None = None) -> DataFrame:
    """Update columns by id where the row still has the change number that the update was computed from."""
    new = updates.select("id", F.col("seq").alias("_seq"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = rows.join(new, "id", "left")
    ok = F.coalesce((F.col("_seq") == F.col("seq")) & (condition if condition is not None else F.lit(True)), F.lit(False))
    return j.withColumns({c: F.when(ok, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def set_sources(photos: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources written back unless the row changed meanwhile or is a known screenshot."""
    return update_if_current(photos, sources, ["source"], ~F.coalesce(F.col("apple_shot"), F.lit(False)))


def mark_screenshots(photos: DataFrame, shots: DataFrame) -> DataFrame:
    """Screenshots of the photo library, for good: their source is meme."""
    hit = shots.select("path").distinct().withColumn("_shot", F.lit(True))
    j = photos.join(hit, "path", "left").withColumn("apple_shot", F.coalesce("_shot", "apple_shot", F.lit(False)))
    return j.withColumn("source", F.when(F.col("apple_shot"), F.lit(SOURCE_MEME)).otherwise(F.col("source"))).select(*photos.columns)


def unhide_orphans(photos: DataFrame) -> DataFrame:
    """Frames whose stack's top is gone show again."""
    tops = photos.select(F.col("id").alias("stack_top")).withColumn("_top", F.lit(True))
    j = photos.join(tops, "stack_top", "left")
    orphan = (F.col("stack_top") != 0) & F.col("_top").isNull()
    zero = F.lit(0).cast("long")
    return j.withColumns({"stacked": F.when(orphan, F.lit(False)).otherwise(F.col("stacked")), "stack_size": F.when(orphan, zero).otherwise(F.col("stack_size")), "stack_top": F.when(orphan, zero).otherwise(F.col("stack_top"))}).select(*photos.columns)


def star(stars: DataFrame, photos: DataFrame, user: int, photo: int, at: int) -> DataFrame:
    """Star a photo once; unknown photos are left alone."""
    new = photos.filter(F.col("id") == photo).select(F.lit(user).cast("long").alias("user_id"), F.col("id").alias("photo_id"), F.lit(at).cast("long").alias("at"))
    return stars.unionByName(new.join(stars.select("user_id", "photo_id"), ["user_id", "photo_id"], "left_anti").select(*stars.columns))


def unstar(stars: DataFrame, user: int, photo: int) -> DataFrame:
    return stars.filter(~((F.col("user_id") == user) & (F.col("photo_id") == photo)))


def add_feedback(feedback: DataFrame, photos: DataFrame, row: dict) -> DataFrame:
    """Append a judgement: a rating of 0 to 10, or one of the verdicts, of a photo that exists."""
    rating, verdict = row.get("rating"), row.get("verdict")
    if rating is None and verdict not in ("agree", "high", "low") or rating is not None and not 0 <= rating <= 10:
        raise ValueError("a rating of 0 to 10 or a verdict is needed")
    open_schema = T.StructType([T.StructField(f.name, f.dataType) for f in feedback.schema])
    new = feedback.sparkSession.createDataFrame([row], open_schema)
    return feedback.unionByName(new.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select(*feedback.columns))


def is_stale(meta: dict[str, str], rules: int, options: str, seq: int, dirty: str) -> bool:
    """Do derived tables need a rebuild? Rules, options, change number and dirty counter are compared with the last run's."""
    return (meta.get("rules"), meta.get("options"), meta.get("seq"), meta.get("dirty")) != (str(rules), options, str(seq), dirty)


def recent(rows: DataFrame, limit: int, at: str = "at") -> DataFrame:
    return rows.orderBy(F.col(at).desc(), F.col("path").asc()).limit(limit)


def add_root(roots: DataFrame, path: str, at: int) -> DataFrame:
    new = roots.sparkSession.createDataFrame([(path, at, None)], "path string, added_at long, name string")
    return roots.unionByName(new.join(roots.select("path"), "path", "left_anti").select(*roots.columns))


def put_value(meta: DataFrame, key: str, value: str) -> DataFrame:
    return upsert(meta, meta.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])
