"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import keep, materialize, release


def _unsettled(links: DataFrame) -> bool:
    """Whether some node of (node, low) has several lower nodes, or is both a lower node and above one."""
    ends = links.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").limit(1).count() > 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node it can reach.

    Links run from a node to a lower one. Large-star hangs the higher neighbours of every node on the least node it
    knows, small-star the lower ones and the node itself; both keep components together, and rounds go on until
    every component is a star around its least node. They take at most the square of the logarithm of the number of nodes,
    however long the chains are and however their nodes are numbered, so no number of rounds is set. Aggregates combine
    before their shuffle, so a hub costs a row a task; every round is written out, which ends its lineage."""
    pairs = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low"))
    links = materialize(pairs.filter("node <> low").distinct(), "components")
    while _unsettled(links):
        both = links.unionByName(links.select(F.col("low").alias("node"), F.col("node").alias("low")))
        least = both.groupBy("node").agg(F.least(F.first("node"), F.min("low")).alias("least"))
        large = links.join(least.withColumnRenamed("node", "via"), links["low"] == F.col("via")).select("node", F.col("least").alias("low")).distinct()
        large = keep(large)
        least = large.groupBy("node").agg(F.min("low").alias("least"))
        small = large.join(least.withColumnRenamed("node", "via"), large["node"] == F.col("via")).filter("low <> least").select(F.col("low").alias("node"), F.col("least").alias("low"))
        after = materialize(small.unionByName(least.select("node", F.col("least").alias("low"))).distinct(), "components")
        release(links, large)
        links = after
    # Stars: a root stands above its nodes, and nodes linked only to themselves above none.
    named = links.unionByName(links.select(F.col("low").alias("node"), "low")).unionByName(pairs.filter("node = low"))
    return named.groupBy("node").agg(F.min("low").alias("component"))
