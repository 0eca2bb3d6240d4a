"""Line dedup: a levelled store of sorted runs of line hashes; each batch merge-anti-joins the runs and adds its own.

A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least ``min_chars``
code points that at least two documents hold lose all their lines except in the smallest doc_id.
A run is a table (h1, h2, owner) bucketed by the 128-bit key hash as Spark's shuffles deal it out, each bucket one sorted
file. So a batch's keys, combined and dealt out once, merge with every run as it lies: no run is shuffled or sorted again.
Batches come in ascending doc_id order, so a key that an earlier run holds belongs to an earlier document.
Lines go by their number in the document, and what stays is picked by number, so a long text costs in proportion.

Nulls and odd input: a null text is one empty line; a null doc_id counts as the largest id, all null
ids as one document; rows that repeat a doc_id are one document for ownership and are all returned;
an empty table gives an empty result; other columns pass through ``dedup_lines`` untouched.
Main path: DataFrame functions only.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.common import BLANKS, ascii_lowered, keep, scratch_path

#: Stands for a null doc_id: it comes after every other id.
LAST_ID = (1 << 63) - 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Blanks stripped; A-Z lowered."""
    return ascii_lowered(F.trim(line, F.lit(BLANKS)))


def key_hash(line: Column, min_chars: int) -> Column:
    """128 bits as a struct of two independently seeded 64-bit hashes; null for a key that is too short."""
    key = line_key(line)
    return F.when(
        F.char_length(F.trim(line, F.lit(BLANKS))) >= min_chars,
        F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")),
    )


class RunStore:
    """Levelled sorted runs: a level that holds ``fanout`` runs is merged into one run of the next level."""

    #: Lets Spark rely on the order inside a bucket of one file.
    SCANS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name).select("h1", "h2", "owner") for level in self.levels for name in level]

    @contextlib.contextmanager
    def _sorted_scans(self):
        before = {k: self.spark.conf.get(k) for k in self.SCANS}
        try:
            for k, v in self.SCANS.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _write(self, keys: DataFrame) -> str:
        """keys lie dealt by (h1, h2), so every bucket is one file."""
        path = scratch_path(self.spark, "line-run")
        name = "line_run_" + path.rsplit("-", 1)[1]
        keys.select("h1", "h2", "owner").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def marked(self, pairs: DataFrame) -> DataFrame:
        """(h1, h2, first, last, owner) of a batch's keys: owner is that of the run that holds the key, if one does."""
        keys = pairs.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        owners = []
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.withColumnRenamed("owner", f"owner{i}").hint("merge"), ["h1", "h2"], "left")
            owners.append(f"owner{i}")
        return keys.select("h1", "h2", "first", "last", F.coalesce(F.lit(None).cast("long"), *owners).alias("owner"))

    def add(self, pairs: DataFrame) -> DataFrame:
        """Take a batch of (doc, h1, h2, ...); return those of its rows whose lines go, and keep its new keys as a run."""
        with self._sorted_scans():
            keys = keep(self.marked(pairs))
            self.levels[0].append(self._write(keys.filter("owner is null").select("h1", "h2", F.col("first").alias("owner"))))
            self.compact()
        repeated = keys.filter("owner is not null or last > first").select("h1", "h2", F.coalesce("owner", "first").alias("owner"))
        return pairs.join(repeated, ["h1", "h2"]).filter(F.col("doc") != F.col("owner"))

    def compact(self) -> None:
        """Runs are merged bucket by bucket: no key is in two of them, so a full merge join is their union in order."""
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = level[0]
                for name in level[1:]:
                    both = self.spark.table(merged).join(self.spark.table(name).withColumnRenamed("owner", "_owner").hint("merge"), ["h1", "h2"], "full")
                    merged = self._write(both.select("h1", "h2", F.coalesce("owner", "_owner").alias("owner")))
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(merged)
                self.levels[depth] = []
                self._drop(level)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(doc, sub): the document for ownership, and which of its texts."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_sub")]


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, n_batches: int) -> DataFrame:
    """(_doc, _sub, _gone): for each document the numbers of the lines that it loses."""
    doc, sub = row_key(id_col, text_col)
    # The key is computed before lines are listed: a line's row must not carry its text along.
    lines = docs.select(doc.alias("doc"), sub.alias("sub"), split_lines(F.col(text_col)).alias("lines")).select("doc", "sub", F.posexplode("lines").alias("at", "line"))
    pairs = lines.select("doc", "sub", "at", key_hash(F.col("line"), min_chars).alias("k")).filter("k is not null")
    pairs = keep(pairs.select("doc", "sub", "at", "k.h1", "k.h2"))
    cuts = [i / n_batches for i in range(1, n_batches)]
    edges = pairs.select(F.percentile_approx("doc", F.array(*map(F.lit, cuts)), max(1000, 100 * n_batches)).alias("e")).first()["e"] if cuts else None
    edges = sorted(set(edges or []))
    store, drops = RunStore(docs.sparkSession), []
    for i in range(len(edges) + 1):
        batch = pairs
        if i > 0:
            batch = batch.filter(F.col("doc") > edges[i - 1])
        if i < len(edges):
            batch = batch.filter(F.col("doc") <= edges[i])
        drops.append(store.add(batch).select("doc", "sub", "at"))
    out = drops[0]
    for more in drops[1:]:
        out = out.unionByName(more)
    # Rows equal in id and text name each of their lines more than once.
    return out.groupBy(F.col("doc").alias("_doc"), F.col("sub").alias("_sub")).agg(F.collect_set("at").alias("_gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, n_batches: int = 3) -> DataFrame:
    """docs with ``_n_lines``, ``_n_dropped`` and ``_kept`` (the text that stays)."""
    drops = dropped_lines(docs, id_col, text_col, min_chars, n_batches)
    rows = docs.select("*", *row_key(id_col, text_col)).join(drops, ["_doc", "_sub"], "left")
    rows = rows.withColumn("_lines", split_lines(F.col(text_col)))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.transform(numbers, lambda i: F.get(F.col("_lines"), i)))
    return (
        rows.withColumn("_left", left)
        .withColumn("_n_lines", F.size("_lines").cast("long"))
        .withColumn("_n_dropped", (F.size("_lines") - F.size("_left")).cast("long"))
        .withColumn("_kept", F.array_join("_left", "\n"))
        .drop("_doc", "_sub", "_gone", "_lines", "_left")
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, x[i] AS line,
         translate(trim(x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(generate_series(1, len(x))) AS g(i)),
owners AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.doc_id, l.i, l.line, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM lines l LEFT JOIN owners o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
