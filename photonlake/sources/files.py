"""File sources: a recursive listing with exclusions, incremental skips and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions.paths import excluded

#: File name extensions that are read.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif", "avif")
RAW_EXTENSIONS = ("cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "raf", "orf", "rw2", "pef", "srw", "raw", "rwl", "3fr", "fff", "iiq", "mos", "mrw", "kdc", "erf")


def extension(p: Column) -> Column:
    return F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))


def listing(spark: SparkSession, root: str, min_size: int = 0, patterns: list[str] = (), content: bool = False) -> DataFrame:
    """(path, size, mtime[, content]) of the image files below root. Without content no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), *(["content"] if content else []))
    return out.filter(extension(F.col("path")).isin(*IMAGE_EXTENSIONS, *RAW_EXTENSIONS) & (F.col("size") >= min_size) & ~excluded(F.col("path"), list(patterns)))


def files_to_read(found: DataFrame, known: DataFrame, errors: DataFrame | None = None, version: int = 0, retry: bool = False) -> DataFrame:
    """Files that are not known unchanged at this version or later, nor failed unchanged (unless retried)."""
    out = found.join(known.filter(F.col("version") >= version).select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    if errors is not None and not retry:
        out = out.join(errors.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")
    return out


def fingerprint(size: Column, content: Column) -> Column:
    """32 hex digits over the size (8 bytes, little end first) and all bytes."""
    return F.substring(F.sha2(F.concat(_little(size), content), 256), 1, 32)


def _little(n: Column) -> Column:
    """An integer as 8 bytes, least first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def legacy_fingerprint(size: Column, content: Column, edge: int = 65536) -> Column:
    """24 hex digits over the size and both ends of the file, as older catalogues have."""
    tail = F.substr(content, F.greatest(F.length(content) - edge + 1, F.lit(1)), F.lit(edge))
    return F.substring(F.sha1(F.concat(_little(size), F.substr(content, F.lit(1), F.lit(edge)), tail)), 1, 24)


def record_errors(errors: DataFrame, failed: DataFrame, at: int) -> DataFrame:
    """Errors with those of this run in place of older ones of the same path."""
    new = failed.select("path", "size", "mtime", "error", F.lit(at).cast("long").alias("at"))
    return errors.join(new.select("path"), "path", "left_anti").unionByName(new)


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, other): files of a and b (path, size, content) that are equal byte for byte. Sizes and hashes find the
    candidates; the bytes decide."""
    keyed = lambda rows: rows.withColumn("_h", F.xxhash64("content"))
    other = keyed(b).select(F.col("path").alias("other"), "size", "_h", F.col("content").alias("_bytes"))
    return keyed(a).join(other, ["size", "_h"]).filter(F.col("content") == F.col("_bytes")).select("path", "other")
