"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join. The minima are a staged table, so both sides of the join are plain shuffles, and a node with
very many neighbours is only a skewed join key, which adaptive execution splits. Every round's edges are a staged table; rounds grow with
the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b, each once, staged. Large: a node's larger neighbours go to its least one; small: its smaller ones and itself do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "components")
        out = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = stage(edges.groupBy("a").agg(F.min("b").alias("m")), "components")
        out = edges.join(least, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.toDF("a", "b"))
    stars = stage(out.filter(F.col("a") > F.col("b")).distinct(), "components")
    drop(least)
    return stars


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node reachable. Null ends and loops are ignored."""
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "components")
    while True:
        large = _star(edges, large=True)
        small = _star(large, large=False)
        drop(edges, large)
        edges = small
        # done when no node has two neighbours below it, and no least node a neighbour below
        forks = edges.groupBy("a").count().filter("count > 1").limit(1).count()
        if not forks and not edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
    return edges.toDF("node", "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
