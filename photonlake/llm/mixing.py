"""Mixing sources to target weights by a low-discrepancy slot schedule.

Slot i of the schedule takes the golden-ratio point frac(i * phi), maps it through the cumulative
target shares to a source and gets its rank r among that source's slots. Each source's documents, in
a hashed shuffle, form a cyclic stream of words that is cut into blocks of ``block`` words; slot rank r
takes block r. Sources that the schedule leaves a block short get those slots at its end, and the last
block of a source stops at its target, so every source takes floor(target) words exactly.

Targets: weights 1, 2, 3, repeating over the sources by code point (null last), share all words; a
target stops at ``max_epochs`` times its source's size and the excess is reshared by weight.

Nulls and odd input: a null text has no words and is never taken; a null source is a source of its own;
rows with equal or null doc_id are separate rows, told apart by a 128-bit hash of all their columns (rows equal in all of
them are interchangeable); an empty table gives an empty result; helper columns start with an underscore, so other
columns do no harm. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from photonlake.llm.common import BLANK_RUN, keep, ranked_bucket, square_buckets, with_running_total

#: Slots are numbered below 2^40; the step is the odd integer next to 2^40 / phi.
POINT_BITS = 40
GOLDEN_STEP = round((math.sqrt(5) - 1) / 2 * (1 << POINT_BITS)) | 1


def golden_point(i):
    """frac(i / phi) as an integer below 2^40, multiplied in two halves so that no product leaves 63 bits."""
    half = 1 << (POINT_BITS // 2)
    high = F.floor(i / half).cast("long") * GOLDEN_STEP % half * half
    low = i % half * GOLDEN_STEP
    return (high + low) % (1 << POINT_BITS)


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: _no_source, _source, _idx, _total, target, _take. Water-filling in one ordered pass:
    sources in the order of size over weight are capped until the even level fits under the next cap."""
    every = sizes.groupBy("_no_source", "_source").agg(F.sum("size").alias("_total"))
    order = W.orderBy("_no_source", "_source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = every.withColumn("_w", w).withColumn("_idx", F.row_number().over(order))
    by_ratio = W.orderBy(F.col("_total") / F.col("_w"), "_idx")
    capped = F.coalesce(F.sum(F.col("_total") * max_epochs).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    every = every.withColumn("_all", F.sum("_total").over(W.partitionBy())).withColumn("_level", (F.col("_all") - capped) / rest).withColumn("_pos", F.row_number().over(by_ratio))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_total") * max_epochs, F.col("_pos"))
    level = F.min(F.struct(fits.isNull().alias("no"), F.coalesce(fits, F.lit(0)).alias("at"), F.col("_level").alias("level"))).over(W.partitionBy())["level"]
    target = F.least((F.col("_total") * max_epochs).cast("double"), level * F.col("_w"))
    return every.withColumn("target", target).withColumn("_take", F.floor("target").cast("long")).select("_no_source", "_source", "_idx", "_total", "target", "_take")


def schedule(sources: DataFrame, block: int, cells: int = 4096) -> DataFrame:
    """(_idx, _rank, slot): which slot of the mix takes which block of which source."""
    spark = sources.sparkSession
    need = sources.filter("_take > 0").select("_idx", F.ceil(F.col("_take") / block).cast("long").alias("_need"))
    upto = F.sum("_need").over(W.orderBy("_idx"))
    scale = F.lit(float(1 << POINT_BITS)) / F.sum("_need").over(W.partitionBy())
    # Shares as ranges of points; each range is listed in the cells it meets, so the lookup is an equi-join.
    edges = need.withColumn("_lo", F.floor((upto - F.col("_need")) * scale).cast("long")).withColumn("_hi", F.floor(upto * scale).cast("long"))
    width = (1 << POINT_BITS) // cells
    edges = keep(edges)
    n_slots = edges.agg(F.coalesce(F.sum("_need"), F.lit(0)).alias("n")).first()["n"]
    listed = edges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width)))).filter("_hi > _lo")
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("_point"))
    slots = slots.withColumn("_cell", F.floor(F.col("_point") / width))
    slots = slots.join(listed, "_cell").filter("_point >= _lo and _point < _hi").select("slot", "_idx", "_need")
    # Ranks of a source's slots, counted by runs of slot numbers and then inside a run.
    run = max(1, int(max(n_slots, 1) ** 0.5 / 4))
    slots = keep(slots.withColumn("_run", F.floor(F.col("slot") / run)).withColumn("_one", F.lit(1)))
    ranked = with_running_total(slots, ["_idx"], "_run", ["slot"], "_one").select("_idx", F.col("run_start").cast("long").alias("_rank"), "slot", "_need")
    held = slots.groupBy("_idx").agg(F.count("*").alias("_held"))
    short = edges.join(held, "_idx", "left").withColumn("_held", F.coalesce("_held", F.lit(0))).filter("_held < _need")
    short = short.select("_idx", F.explode(F.sequence("_held", F.col("_need") - 1)).alias("_rank"))
    short = short.withColumn("slot", F.lit(n_slots) + F.col("_rank") * (1 << 20) + F.col("_idx"))
    return ranked.filter("_rank < _need").select("_idx", "_rank", "slot").unionByName(short)


ROW = ["_r1", "_r2"]


def with_row_key(docs: DataFrame) -> DataFrame:
    """docs with ``ROW``: 128 bits of hash over all columns."""
    return docs.withColumns({"_r1": F.xxhash64(*docs.columns), "_r2": F.xxhash64(F.lit(7), *docs.columns)})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_epochs: int = 3, block: int = 1024):
    """(rows, pieces). rows: _r1, _r2, id, size, source_size, target, taken, first_slot per input row (first_slot: where the
    schedule first takes it, null where it does not). pieces: the mix itself, one row per slot and document part:
    slot, _r1, _r2, row (number of the row), id, size, epoch, first word in the document, words."""
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sizes = with_row_key(docs).select(
        *ROW,
        F.col(id_col).alias("_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(BLANK_RUN)).cast("long"), F.lit(0)).alias("size"),
        F.col(source_col).isNull().alias("_no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        F.md5(identity.cast("binary")).alias("_digest"),
    )
    sizes = keep(sizes)
    sources = keep(source_targets(sizes, weights, max_epochs))
    n = square_buckets(sizes.count())
    placed = with_running_total(
        sizes.withColumn("_bucket", ranked_bucket(F.col("_digest"), n)), ["_no_source", "_source"], "_bucket", ["_digest", "_id", "size", *ROW], "size", extra=sources
    )
    placed = keep(placed.drop("_digest", "_no_source", "_source").withColumn("_start", F.col("run_start").cast("long")).drop("run_start"))
    from_ = F.col("_epoch") * F.col("_total") + F.col("_start")
    parts = (
        placed.filter("size > 0 and _start < _take")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("_from", from_)
        .filter("_from < _take")
        .withColumn("_to", F.least(F.col("_from") + F.col("size"), "_take"))
        .withColumn("_rank", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    )
    first = F.greatest("_from", F.col("_rank") * block)
    number = F.struct("_idx", "_bucket", "seq").alias("row")
    pieces = parts.join(schedule(sources, block), ["_idx", "_rank"]).select(
        "slot", *ROW, number, F.col("_id").alias("id"), "size", F.col("_epoch").alias("epoch"), (first - F.col("_from")).alias("first_word"), (F.least("_to", (F.col("_rank") + 1) * block) - first).alias("words")
    )
    base = placed.select(*ROW, number, F.col("_id").alias("id"), "size", F.col("_total").alias("source_size"), "target", F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("slot"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("_r1", "long"), ("_r2", "long"), ("id", docs.schema[id_col].dataType), ("size", "long"), ("source_size", "long"), ("target", "double"))]
    taken = base.unionByName(pieces.select(*none, "row", "words", "slot")).groupBy("row")
    whole = [F.max(c).alias(c) for c in (*ROW, "id", "size", "source_size", "target")]
    rows = taken.agg(*whole, F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    return rows.drop("row"), pieces


def copies(pieces: DataFrame) -> DataFrame:
    """(_r1, _r2, _slot, _row): one row for every copy of a document in the mix, with the slot where it begins. A document
    that a source's target cuts counts as a copy when at least half of its words are taken."""
    whole = pieces.groupBy(*ROW, "row", "epoch").agg(F.sum("words").alias("_words"), F.max("size").alias("_size"), F.min("slot").alias("_slot"))
    return whole.filter("2 * _words >= _size").select(*ROW, "_slot", F.col("row").alias("_row"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs)[0].drop(*ROW).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM sized GROUP BY source),
s1 AS (SELECT *, ((idx - 1) % 3 + 1)::DOUBLE AS w, sum(total) OVER ()::BIGINT AS every FROM s0),
s2 AS (SELECT *, (every - coalesce(sum(3 * total) OVER (ORDER BY total / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                 / sum(w) OVER (ORDER BY total / w, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl,
              row_number() OVER (ORDER BY total / w, idx) AS pos FROM s1),
s3 AS (SELECT arg_min(lvl, pos) FILTER (WHERE lvl * w <= 3 * total) AS lvl FROM s2),
s4 AS (SELECT source, idx, total, least((3 * total)::DOUBLE, s3.lvl * w) AS target, floor(least((3 * total)::DOUBLE, s3.lvl * w))::BIGINT AS take FROM s2, s3),
d AS (SELECT doc_id, size, idx, total, target, take,
             coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM sized JOIN s4 ON sized.source IS NOT DISTINCT FROM s4.source),
need AS (SELECT DISTINCT idx, ((take + 1023) // 1024)::BIGINT AS need FROM (SELECT s2.idx, floor(least((3 * s2.total)::DOUBLE, s3.lvl * s2.w))::BIGINT AS take FROM s2, s3) WHERE take > 0),
edge AS (SELECT *, sum(need) OVER (ORDER BY idx)::BIGINT AS upto, sum(need) OVER ()::BIGINT AS n FROM need),
cut AS (SELECT idx, need, n, floor((upto - need) * (1099511627776::DOUBLE / n))::BIGINT AS lo, floor(upto * (1099511627776::DOUBLE / n))::BIGINT AS hi FROM edge),
slot AS (SELECT i, (i::HUGEINT * 679535556991 % 1099511627776)::BIGINT AS point FROM (SELECT unnest(range(coalesce((SELECT max(n) FROM cut), 0))) AS i)),
ranked AS (SELECT cut.idx, cut.need, slot.i AS slot, row_number() OVER (PARTITION BY cut.idx ORDER BY slot.i) - 1 AS r FROM slot JOIN cut ON point >= lo AND point < hi),
plan AS (SELECT idx, r, slot FROM ranked WHERE r < need
         UNION ALL SELECT c.idx, g.r, c.n + g.r * 1048576 + c.idx FROM cut c, (SELECT unnest(range((SELECT max(need) FROM cut))) AS r) g
         WHERE g.r < c.need AND g.r >= (SELECT count(*) FROM ranked x WHERE x.idx = c.idx)),
f AS (SELECT d.*, CASE WHEN size > 0 AND start < take THEN start // 1024 END AS r FROM d)
SELECT doc_id, size, total AS source_size, target,
       CASE WHEN total = 0 THEN 0 ELSE (take // total) * size + greatest(0, least(size, take % total - start)) END::BIGINT AS taken,
       p.slot::BIGINT AS first_slot
FROM f LEFT JOIN plan p ON p.idx = f.idx AND p.r = f.r
"""
