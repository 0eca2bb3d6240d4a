"""Result sinks: hits as a table, paths, CSV or JSON with a fixed column order, and numbered exports."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.operators.ordering import ordered_number

from photonlake.functions.times import taken_label

#: Columns of a listing, in order, with their decimals.
LISTING = (("id", None), ("path", None), ("overall", 1), ("technical", 1), ("aesthetic", 2), ("focus_score", 2), ("exposure_score", 2), ("taken", None), ("score", 4))


def listing_columns(hits: DataFrame) -> DataFrame:
    """The listing's columns that hits have, rounded."""
    rows = hits.withColumn("taken", taken_label(F.col("taken_at"))) if "taken_at" in hits.columns else hits
    return rows.select(*[F.round(c, n).alias(c) if n is not None else F.col(c) for c, n in LISTING if c in rows.columns])


def write_listing(hits: DataFrame, path: str, form: str) -> None:
    """csv (with a header), json (one object a line) or paths (one a line)."""
    rows = listing_columns(hits)
    if form == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        rows.write.mode("overwrite").json(path)
    elif form == "paths":
        rows.select("path").write.mode("overwrite").text(path)
    else:
        raise ValueError("form must be csv, json or paths")


def export_names(hits: DataFrame, order: list) -> DataFrame:
    """(path, target): 0001_name and so on in the given order, four digits at least."""
    n = F.col("_nth")
    return ordered_number(hits, order, "_nth").select("path", F.concat(F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")), F.lit("_"), F.regexp_extract("path", r"[^/\\]+$", 0)).alias("target"))


def export_files(hits: DataFrame, order: list, folder: str, limit: int, link: bool = False) -> int:
    """Copy or link the first ``limit`` files; existing targets are left alone, and nothing is written through a link."""
    os.makedirs(folder, exist_ok=True)
    if os.path.islink(folder):
        raise ValueError("the export folder is a link")
    done = 0
    for row in export_names(hits.orderBy(*order).limit(limit), order).collect():
        target = os.path.join(folder, row["target"])
        if os.path.lexists(target):
            continue
        if link:
            os.symlink(os.path.abspath(row["path"]), target)
        else:
            part = f"{target}.part"
            shutil.copyfile(row["path"], part)
            os.rename(part, target)
        done += 1
    return done
