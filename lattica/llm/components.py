"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Tables


def _min_neighbour(e: DataFrame) -> DataFrame:
    """For each u the least of u and its neighbours; partial minima are taken before the shuffle."""
    return e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component) for every node of `edges` (u, v): the least node it is linked with, itself included.

    Each step joins edges with per-node minima, so a node with very many neighbours is only a skewed
    join key, never a group in one task; steps are written to the checkpoint folder, the one before is
    dropped, and they stop when the edges are a forest of stars around least nodes. Their number grows
    with the logarithm of the longest path.
    """
    tables = tables or Tables(edges.sparkSession)
    e = tables.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        parents = e.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        centres = e.select(F.col("v").alias("u")).distinct()
        crooked = parents.join(centres.withColumn("centre", F.lit(True)), "u", "left").where("lo < hi or centre")
        if crooked.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_min_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.join(_min_neighbour(large), "u")
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, tables.keep(small)
        tables.drop(before)
    done = tables.keep(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct()))
    tables.drop(e)
    return done
