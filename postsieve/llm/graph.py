"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.session import materialise


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of a star or linked to one centre alone."""
    sides = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("v")))
    # A centre has no link of its own: of its two columns one is null. Counts combine in every task.
    seen = sides.groupBy("node").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count_if(F.col("v").isNull()).alias("c"))
    return seen.filter((F.col("a") != F.col("b")) | (F.col("a").isNotNull() & (F.col("c") > 0))).isEmpty()


def _least_neighbour(both: DataFrame) -> DataFrame:
    return materialise(both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(u, v)``; a component is named by its least node.

    Alternates two star steps until only stars are left: first every larger neighbour of a node is linked to the least of
    its neighbourhood, then every smaller one. Each step is written, and the number of steps grows with the logarithm
    of the longest path. Loops and repeated edges do no harm; a node that only has a loop is left out.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Repeated links go with the others below.
        large = materialise(large, "large")
        least = _least_neighbour(large)
        linked = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(linked.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct(), "stars")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
