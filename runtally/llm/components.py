"""Connected components of an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runtally.llm.rows import kept


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the edges (a, b): root is the smallest node that can be reached.

    Until every component is a star around its smallest node, a round replaces the edges of a node by edges to its smallest
    neighbour, first for the larger neighbours, then for the smaller ones; the number of rounds grows with the logarithm of the
    longest path. Hubs are pre-aggregated before their shuffle: a node needs the minimum of its neighbours, which its rows then
    join. Null ends and loops are ignored.
    """
    pairs = kept(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while not _stars(pairs):
        least = kept(pairs.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        up = kept(pairs.join(least, pairs["lo"] == least["u"], "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct())
        least = kept(up.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        down = up.join(least, up["hi"] == least["u"]).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(least)
        pairs = kept(down.distinct())
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(pairs.select("lo", "lo").distinct())


def _stars(pairs: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or smaller and larger ones."""
    ends = pairs.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        pairs.select("lo", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down > 0)").isEmpty()
