"""Schemas of the catalogue's entities, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PHOTOS = """id long, path string, size long, mtime long, fingerprint string, format string, width int, height int, taken_at long,
camera_make string, camera_model string, lens string, focal_length double, focal35 double, fnumber double, exposure_time double,
iso int, flash boolean, gps_lat double, gps_lon double, artist string, phash long, sharpness double, sharpness_global double,
face_sharpness double, brightness double, highlights double, shadows double, dynamic_range double, contrast double,
cast_a double, cast_b double, cast_strength double, colorfulness double, saturation double, monochrome boolean, noise double,
focus_score double, exposure_score double, color_score double, noise_score double, technical double, aesthetic double,
overall double, face_count int, blockiness double, source int, apple_shot boolean, indexed_at long, version int, seq long,
burst_id long, stack_top long, stack_size long, stacked boolean, dup_id long"""

TABLES = {
    "photos": PHOTOS,
    "photo_clip": "photo_id long, clip array<float>",
    "people": "id long, name string, created_at long",
    "faces": "id long, photo_id long, ordinal int, x1 double, y1 double, x2 double, y2 double, score double, width_px double, sharpness double, yaw double, embedding array<float>, person_id long, person_source string, person_sim double",
    "tags": "photo_id long, tag string, score double",
    "photo_groups": "kind int, id long, size long, start_at long, end_at long, oldest_at long, camera string, best_id long, best_overall double, min_overall double, max_technical double, max_aesthetic double, max_focus double, focus_sharp double, max_colorful double, max_faces int, faces_overall double, memes long, members array<long>",
    "folders": "path string, parent string, total long, cover_id long, cover_overall double, newest_at long, scored long, score_sum double, memes long",
    "roots": "path string, added_at long, name string",
    "errors": "path string, size long, mtime long, error string, at long",
    "meta": "key string, value string",
    "aesthetic_models": "id string, name string, kind string, parent string, model string, active boolean, weight double, metrics string, created_at long",
    "aesthetic_scores": "photo_id long, model string, score double",
    "aesthetic_feedback": "id long, photo_id long, rater string, rating double, verdict string, shown double, models string, created_at long",
    "stars": "user_id long, photo_id long, at long",
    "users": "id long, name string, name_key string, role string, pw_hash string, created_at long, disabled_at long",
    "invites": "token_hash string, name string, role string, user_id long, created_by string, created_at long, expires_at long, used_at long",
    "sessions": "token_hash string, user_id long, created_at long, expires_at long, last_seen long, client string",
}

#: Values of photos.source and of photo_groups.kind.
SOURCE_UNKNOWN, SOURCE_CAMERA, SOURCE_SAVED, SOURCE_MEME = 0, 1, 2, 3
GROUP_BURST, GROUP_DUPLICATE = 1, 2


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A catalogue table with its declared schema: columns that older files lack read as null."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


#: Values of columns that older tables lack, where null is not meant.
DEFAULTS = {
    "photos": {"face_count": 0, "blockiness": 1.0, "source": 0, "apple_shot": False, "seq": 0, "burst_id": 0, "stack_top": 0, "stack_size": 0, "stacked": False, "dup_id": 0},
    "photo_groups": {"oldest_at": 0, "faces_overall": 0.0, "memes": 0},
    "folders": {"newest_at": 0, "scored": 0, "score_sum": 0.0, "memes": 0},
}


def migrate_table(name: str, table: DataFrame) -> DataFrame:
    """A table of an older version with today's columns: missing ones are added with their default, the others cast."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    defaults = DEFAULTS.get(name, {})
    have = set(table.columns)
    wanted = T.StructType.fromDDL(TABLES[name])
    return table.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in wanted])


def migrate(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a catalogue in today's schema; vectors that older versions kept with the photos move to their own."""
    out = dict(tables)
    photos = out.get("photos")
    if photos is not None and "clip" in photos.columns:
        moved = photos.filter("clip is not null").selectExpr("id as photo_id", "clip")
        known = out.get("photo_clip")
        out["photo_clip"] = moved if known is None else known.join(moved.select("photo_id"), "photo_id", "left_anti").unionByName(moved)
    return {name: migrate_table(name, t) for name, t in out.items()}
