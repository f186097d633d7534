"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.session import cut_lineage


def _pull(edges: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours, joined to the edges again; hot nodes combine on the map side."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumn("m", F.least("u", "m")), "u")


#: Rows of a partition of the edge table, which every round reads again.
ROWS = 200_000


def _kept(edges: DataFrame) -> DataFrame:
    """Written and cut off, in as many partitions as its rows are worth."""
    written = cut_lineage(edges)
    return written.coalesce(max(1, -(-written.count() // ROWS)))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour that has none itself: then nothing can move any more."""
    split = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    moving = edges.select(F.col("v").alias("u")).distinct().join(split.select("u"), "u", "left_semi")
    return split.filter("n > 1").select("u").union(moving).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ends of the links (a, b): the smallest id that can be reached.

    Alternates large stars (a node's greater neighbours move to its smallest) and small stars (its smaller ones do), which
    ends after a number of rounds that grows with the logarithm of the nodes, without a hub ever gathering its edges in
    one task. Each round is written and cut off. Links of a node with itself only name the node.
    """
    every = _kept(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    alone = every.filter("u = v").select(F.col("u").alias("id"))
    edges = every.filter("u <> v")
    while not _stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = _pull(_pull(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = _kept(
            small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        )
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return stars.union(roots).union(alone.select("id", F.col("id").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))
