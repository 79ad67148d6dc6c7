"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.tables import stored


def _towards_least(edges: DataFrame) -> DataFrame:
    """Join all smaller neighbours of a node, and the node, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _larger_to_least(edges: DataFrame) -> DataFrame:
    """Join all larger neighbours of a node to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # Only a node with a smaller neighbour moves its larger ones; else they point at it already.
    joined = both.join(least, "a").filter("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node of edges (a, b).

    Each round points larger nodes at smaller ones and is written to the shared folder; a few
    rounds suffice, as the distance to the least node shrinks geometrically. Only a count and a
    hash of each round come to the driver.
    """
    directed = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = stored(directed, "edges"), None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        current = stored(_towards_least(_larger_to_least(current)), "edges")
    roots = current.select(F.col("b").alias("a"), "b").distinct()
    return current.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
