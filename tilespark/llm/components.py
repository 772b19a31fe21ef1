"""Connected components by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``), the component being its smallest node.

    Each round a node hands its smallest neighbour to its larger neighbours (large star), then to its smaller ones and
    itself (small star), which halves paths at least. Rounds end when all links are of stars: each node has one smaller
    neighbour, and that has none. Links of a node with itself and repeated ones add nothing; no links give no rows.
    """
    edges = checkpointed(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(low.select("a", F.col("least").alias("b")))
        edges = checkpointed(small.where("a != b").distinct())
        many = edges.groupBy("a").count().where("count > 1").select("a")
        inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if many.unionByName(inner).isEmpty():
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
