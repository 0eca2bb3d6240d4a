"""Streaming twins of the batch operators over a change feed of photos or events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.operators.maintenance import upsert


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    out = events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("size"), F.min("event_id").alias("burst_id"), F.max("value").alias("best"))
    return out.select(key, "burst_id", "size", "best", F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("closed_at"))


def stream_bursts(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Bursts per key as sessions: steps up to the gap join. A session closes once the watermark has passed its end by the
    gap, which is when no later row can join it; state is one open session a key."""
    return _sessions(events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), key, ts, gap)


def batch_bursts(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """The same sessions in batch."""
    return _sessions(events.withColumn(ts, F.col(ts).cast("timestamp")), key, ts, gap)


def run_available(stream: DataFrame, checkpoint: str, out: str) -> DataFrame:
    """Work off what the source has now, appending final rows exactly once; returns the table so far."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def refresh_index(stream: DataFrame, index_path: Callable[[int], str], keys: list[str], seq: str, checkpoint: str) -> None:
    """Keep a keyed table current: every micro-batch keeps the latest change of each key and writes the next version
    beside the last one, so readers swap between whole versions and a retried batch writes the same one again."""
    from photonlake.operators.ordering import top_per_key

    def apply(batch: DataFrame, epoch: int) -> None:
        new = top_per_key(batch, keys, [F.col(seq).desc()])
        if epoch:
            new = upsert(batch.sparkSession.read.parquet(index_path(epoch - 1)), new, keys)
        new.write.mode("overwrite").parquet(index_path(epoch))

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Upkeep:
    """What runs beside a change feed: every trigger brings the index up to date, and derived tables are rebuilt when they are
    stale, at most once in ``rebuild_every`` seconds unless the rules changed or a caller insists."""

    def __init__(self, refresh: Callable[[DataFrame, int], None], rebuild: Callable[[], None], stale: Callable[[], bool], rules_changed: Callable[[], bool], rebuild_every: float = 1800, clock: Callable[[], float] = time.time):
        self.refresh, self.rebuild, self.stale, self.rules_changed = refresh, rebuild, stale, rules_changed
        self.rebuild_every, self.clock, self.last = rebuild_every, clock, -float("inf")

    def regroup(self, now: bool = False) -> bool:
        """Rebuild if that is due; whether it ran."""
        hurry = now or self.rules_changed()
        if not hurry and self.clock() - self.last < self.rebuild_every or not self.stale():
            return False
        self.last = self.clock()
        self.rebuild()
        return True

    def apply(self, batch: DataFrame, epoch: int) -> None:
        self.refresh(batch, epoch)
        self.regroup()

    def start(self, stream: DataFrame, checkpoint: str, every: str = "1 minute", available_now: bool = False):
        """The running query: a micro-batch every interval, or all that the source has now."""
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
