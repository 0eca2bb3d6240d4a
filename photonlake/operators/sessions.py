"""Sessionisation: scenes and bursts per camera, and chunks of bursts.

A camera is its exact make and model. Scenes part where the step exceeds the larger of both gaps; bursts
are the runs of steps up to the burst gap, two frames at least, named by their lowest id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Seconds of the stretches in which the frames of one camera are ordered.
SPAN = 86_400


def mark_sessions(df: DataFrame, keys: list[str], at: str, gaps: dict[str, float], tie: str = "id") -> DataFrame:
    """Number the sessions of every key, a column for each gap: a step of more than the gap starts a new one.

    Two levels keep a key with much of the data off a single task: rows are ordered inside stretches of time, and a table of
    the stretches alone carries the numbers across them."""
    width = max(SPAN, *(16 * gap for gap in gaps.values()))
    rows = df.withColumn("_span", F.floor(F.col(at) / width))
    inside = W.partitionBy(*keys, "_span").orderBy(at, tie)
    step = F.col(at) - F.lag(at).over(inside)
    spans = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_span").alias("_s"), F.col(at).alias("_at"), *[F.when(step > gap, 1).otherwise(0).alias(f"_n_{out}") for out, gap in gaps.items()])
    spans = spans.groupBy(*[f"_k{i}" for i in range(len(keys))], "_s").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), *[F.sum(f"_n_{out}").alias(f"_n_{out}") for out in gaps])
    along = W.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_s")
    pause = F.col("_first") - F.lag("_last").over(along)
    spans = spans.withColumns({f"_b_{out}": F.when(pause > gap, 1).otherwise(0) for out, gap in gaps.items()})
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    spans = spans.withColumns({f"_b_{out}": F.sum(F.col(f"_b_{out}") + F.col(f"_n_{out}")).over(upto) - F.col(f"_n_{out}") for out in gaps}).drop("_first", "_last", *[f"_n_{out}" for out in gaps])
    same = F.col("_span") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = rows.withColumns({f"_n_{out}": F.when(step > gap, 1).otherwise(0) for out, gap in gaps.items()})
    rows = rows.withColumns({f"_n_{out}": F.sum(f"_n_{out}").over(inside.rowsBetween(W.unboundedPreceding, 0)) for out in gaps})
    return rows.join(spans, same).select(*df.columns, *[(F.col(f"_b_{out}") + F.col(f"_n_{out}")).alias(out) for out in gaps])


def scenes_and_bursts(photos: DataFrame, keys: list[str], burst_gap: float, scene_gap: float) -> DataFrame:
    """Dated photos with scene and run numbers per key; burst_id is the lowest id of a run of two or more, else 0."""
    dated = photos.filter(F.col("taken_at") != 0)
    marked = mark_sessions(dated, keys, "taken_at", {"scene": max(scene_gap, burst_gap), "run": burst_gap})
    of = W.partitionBy(*keys, "run")
    return marked.withColumn("run_size", F.count("*").over(of)).withColumn("burst_id", F.when(F.col("run_size") >= 2, F.min("id").over(of)).otherwise(F.lit(0)))


def pack_chunks(frames: DataFrame, keys: list[str], limit: int = 1000) -> DataFrame:
    """Add ``chunk``: consecutive bursts of a scene up to ``limit`` frames together; a longer burst ends the chunk and
    has none (-1). Scenes within the limit are one chunk and never leave the JVM; others are packed by their runs."""
    scene = [*keys, "scene"]
    sized = frames.withColumn("_scene_size", F.count("*").over(W.partitionBy(*scene)))
    small = sized.filter(F.col("_scene_size") <= limit).withColumn("chunk", F.lit(0).cast("long")).drop("_scene_size")
    large = sized.filter(F.col("_scene_size") > limit).drop("_scene_size")
    runs = large.groupBy(*scene, "run").agg(F.count("*").alias("n"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.select(*scene, "run").schema)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        chunk, filled, out = 0, 0, []
        for n in pdf["n"]:
            if n > limit:
                out.append(-1)
                chunk, filled = chunk + (filled > 0), 0
                continue
            if filled + n > limit:
                chunk, filled = chunk + 1, 0
            out.append(chunk)
            filled += n
        return pdf.drop(columns="n").assign(chunk=out)

    packed = runs.groupBy(*scene).applyInPandas(pack, f"{kinds}, chunk long")
    return small.unionByName(large.join(packed, [*scene, "run"]).select(*small.columns))
