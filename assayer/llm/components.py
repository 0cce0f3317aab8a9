"""Connected components by alternating large-star and small-star.

Each step is a grouped minimum and a join, written to the shared folder; the minima
are written first, so that Spark may split the join of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import settled


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settled(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    rising = both.where("b > a").join(least, "a")
    return settled(rising.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")


def _small_star(edges: DataFrame) -> DataFrame:
    least = settled(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return settled(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of edges ``a, b``: the smallest node reachable.

    Loops, repeated edges and either direction are fine; edges with a NULL end are none.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.isnull("a").alias("na"), F.isnull("b").alias("nb"))
    edges = settled(edges.where("not na and not nb and a <> b").select("a", "b").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = _small_star(_large_star(edges))
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
