"""Connected components by alternating large-star and small-star rounds.

Every round is two joins of edges with a minimum per node, written to the shared folder: no
node's neighbours are gathered anywhere, and the number of rounds grows with the logarithm of the size.
The minima are written down before they are joined: few of them are broadcast, so that edges stay where they
are; else both sides are plain shuffles, of which the planner splits a node with very many edges.
Rounds end when the edges no longer change. Null nodes are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, dropped, stored

BROADCAST_NODES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that links reach."""
    u, v = F.col("u").cast("bigint"), F.col("v").cast("bigint")
    now = stored(edges.filter("u != v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    was = None
    while (mark := _mark(now)) != was:
        was, old = mark, now
        now = _small_star(_large_star(now))
        dropped(old)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the smallest of its neighbours and itself. Edges have u > v."""
    both = edges.select("u", F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("m")))
    least = stored(both.groupBy("u").agg(F.min("m").alias("m")), "least")  # a node's greater neighbours are never its minimum
    few = broadcast_if_small(least.withColumnRenamed("u", "v"), BROADCAST_NODES)
    out = stored(edges.join(few, "v").select("u", F.col("m").alias("v")).distinct(), "edges")
    dropped(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them. Edges have u > v."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(broadcast_if_small(least, BROADCAST_NODES), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stored(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
    dropped(edges)
    dropped(least)
    return out
