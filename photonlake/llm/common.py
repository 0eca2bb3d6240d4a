"""Shared pieces: written tables that cut lineage, salted running totals, Arrow text buffers."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes 0x20 and 0x09 to 0x0D: what separates words and is stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests)
    gets one; a cluster must name its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root or root.startswith("<"):
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='photonlake-')}")
        root = context._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def _clean_up() -> None:
    """Scratch tables go with the driver's process, where its session still lives."""
    for spark, path in _scratch:
        with contextlib.suppress(Exception):
            discard(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    if not _scratch:
        atexit.register(_clean_up)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


#: Shuffle files of a finished SQL execution are dropped at once.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, lost executors lose nothing, and the
    shuffles behind it go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out), path)
    return out


_tables: dict[int, tuple[weakref.ref, str]] = {}


def release(*tables: DataFrame) -> None:
    """Delete written tables and blocks that nothing reads any more."""
    for df in tables:
        at = _tables.pop(id(df), None)
        if at is not None and at[0]() is df:
            discard(df.sparkSession, at[1])
        else:
            df.unpersist()


def keep(df: DataFrame) -> DataFrame:
    """Hold a table that is read more than once as blocks on the executors' disks. Lineage stays, so blocks of a lost
    executor are computed again; unlike ``materialize`` it makes no files, which on local stores cost a process each."""
    return df.persist(StorageLevel.DISK_ONLY)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the Hadoop file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lowered(text: Column) -> Column:
    """A-Z lowered and nothing else (for pure ASCII texts ``lower`` is the same and cheaper)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ranked_bucket(digest: Column, n_buckets: int) -> Column:
    """Bucket of a hex digest that rises with the digest, of n_buckets at most 2^32."""
    lead = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(lead * F.lit(n_buckets) / F.lit(float(1 << 32))).cast("long")


def square_buckets(n_rows: int, factor: int = 4) -> int:
    """Buckets per key so that both levels of a salted running total stay near the square root of the rows."""
    return max(1, int(factor * n_rows**0.5))


def with_running_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, extra: DataFrame | None = None) -> DataFrame:
    """Add ``run_start``, the exclusive running total of ``value`` over ``keys`` in bucket, then ``order``; and ``seq`` in the bucket.

    Two levels keep a hot key off a single task: totals per (key, bucket) are accumulated in a
    window over the small totals table, rows only inside their own (key, bucket).
    ``extra`` adds columns by ``keys`` to the totals before they meet the rows.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    if extra is not None:
        totals = totals.join(extra, keys)
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    rows = df.join(totals, [*keys, bucket])
    return (
        rows.withColumn("run_start", F.col("_base") + F.coalesce(F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("seq", F.row_number().over(inside).cast("long"))
        .drop("_base")
    )


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values; nulls are empty. No Python strings are made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def text_slices(batch: pa.RecordBatch, index: int, limit: int = 2_000_000):
    """Cut a batch into runs of rows of about ``limit`` text bytes, so that scratch arrays stay small; a row stays whole."""
    sizes = np.diff(text_buffers(batch.column(index))[1])
    start = total = 0
    for row, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (wraps modulo 2^64)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes, from one prefix polynomial over the buffer."""
    n = len(raw)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), dtype=np.uint64, out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, n + 1)[starts] + mix64((ends - starts).astype(np.uint64)))


_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without blanks, none across rows, and the first word of each row (n + 1)."""
    word = _IS_WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)
