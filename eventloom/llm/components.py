"""Connected components as Spark joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): each node that has an edge to another, and the smallest node that it reaches.

    Each round, every node's larger neighbours move to its smallest neighbour, then its smaller neighbours do, until all that is left are
    stars around the smallest nodes; the rounds grow with the logarithm of the longest path. Smallest neighbours are pre-aggregated and stored before the join, so a
    node that holds many edges is a join key that Spark can split. Null ends, loops and repeated edges have no effect; no edges, no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct())
    while not _stars(now):
        both = now.union(now.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        moved = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(moved.groupBy("u").agg(F.min("v").alias("m")))
        kept = moved.join(least, "u")
        now = cut(kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each u of edges (u, v), all with v < u and none twice, has one edge and is no other edge's v."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 or up > 0 and down > 0")).alias("n")).first()["n"] == 0
