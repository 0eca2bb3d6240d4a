"""Clean-up flows: an application's own copies of photos go, and what people did to them moves to the photo they copy.

A flow takes the tables and gives them back: ``Cleaned`` holds the photos, faces and feedback that stay and a one-row
report. Nothing is changed in place, so a flow that fails leaves the stored tables as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.functions.paths import in_app_cache, is_library_original, library_parts
from photonlake.operators.matching import library_originals, move_labels, twins


@dataclass
class Cleaned:
    photos: DataFrame
    faces: DataFrame
    feedback: DataFrame
    report: DataFrame  # removed, labels_moved, feedback_moved, kept


def _moved(faces: DataFrame, feedback: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces and feedback with the names and judgements of copies on their photos (pairs: copy, original), and the names
    moved (face_id, person_id)."""
    labels = move_labels(pairs, faces)
    named = faces.join(labels.select(F.col("face_id").alias("id"), F.col("person_id").alias("_person")), "id", "left")
    hit = F.col("_person").isNotNull()
    named = named.withColumns({"person_id": F.when(hit, F.col("_person")).otherwise(F.col("person_id")), "person_source": F.when(hit, "manual").otherwise(F.col("person_source"))})
    judged = feedback.join(pairs.select(F.col("copy").alias("photo_id"), "original"), "photo_id", "left").withColumn("photo_id", F.coalesce("original", "photo_id"))
    return named.select(*faces.columns), judged.select(*feedback.columns), labels


def _result(photos: DataFrame, faces: DataFrame, feedback: DataFrame, old_feedback: DataFrame, labels: DataFrame, pairs: DataFrame, removed: DataFrame, kept: DataFrame) -> Cleaned:
    gone = removed.select("id")
    moved = old_feedback.join(pairs.select(F.col("copy").alias("photo_id")), "photo_id", "left_semi")
    counts = [("removed", gone), ("labels_moved", labels), ("feedback_moved", moved), ("kept", kept)]
    report = None
    for name, rows in counts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        report = one if report is None else report.unionByName(one)
    report = report.groupBy().agg(*[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name, _ in counts])
    return Cleaned(photos.join(gone, "id", "left_anti"), faces.join(gone.withColumnRenamed("id", "photo_id"), "photo_id", "left_anti").select(*faces.columns), feedback, report)


def clean_libraries(photos: DataFrame, faces: DataFrame, feedback: DataFrame) -> Cleaned:
    """Photos libraries: files outside the originals folder go where an original of the same library carries their UUID.
    Copies without one stay."""
    part = library_parts(F.col("path"))
    inside = photos.withColumn("_p", part).filter("_p.lib <> ''")
    copies = inside.filter(~is_library_original(F.col("_p.rest"))).select("id", "path")
    originals = inside.filter(is_library_original(F.col("_p.rest"))).select("id", "path")
    pairs = library_originals(copies, originals).withColumnRenamed("id", "copy")
    new_faces, new_feedback, labels = _moved(faces, feedback, pairs)
    removed = pairs.select(F.col("copy").alias("id"))
    return _result(photos, new_faces, new_feedback, feedback, labels, pairs, removed, copies.join(removed, "id", "left_anti"))


def clean_app_caches(photos: DataFrame, faces: DataFrame, feedback: DataFrame) -> Cleaned:
    """Copies in applications' caches go. Names and judgements move to a copy's twin outside any cache. A copy stays when a
    name found no face on its twin, or when it has no twin and either carries something personal or lies in a Photos
    library, where it may be the only copy."""
    cached = in_app_cache(F.col("path"))
    copies, others = photos.filter(cached), photos.filter(~cached)
    pairs = twins(copies, others).select(F.col("id").alias("copy"), F.col("twin").alias("original"))
    new_faces, new_feedback, labels = _moved(faces, feedback, pairs)
    by_hand = new_faces.filter((F.col("person_source") == "manual") & F.col("person_id").isNotNull()).select("photo_id", "person_id")
    wanted = by_hand.join(pairs.select(F.col("copy").alias("photo_id"), "original"), "photo_id").select("photo_id", F.col("original"), "person_id")
    lost = wanted.join(by_hand.withColumnRenamed("photo_id", "original"), ["original", "person_id"], "left_anti").select(F.col("photo_id").alias("id")).distinct()
    alone = copies.join(pairs.select(F.col("copy").alias("id")), "id", "left_anti")
    personal = by_hand.select("photo_id").union(feedback.select("photo_id")).distinct().withColumnRenamed("photo_id", "id").withColumn("_mine", F.lit(True))
    alone = alone.join(personal, "id", "left").filter(F.col("_mine").isNotNull() | (library_parts(F.col("path"))["lib"] != "")).select("id")
    kept = lost.unionByName(alone)
    removed = copies.select("id").join(kept, "id", "left_anti")
    return _result(photos, new_faces, new_feedback, feedback, labels, pairs, removed, kept)
