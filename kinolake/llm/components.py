"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round moves links to smaller ids with a partial minimum and a join that adaptive execution
can split, so a node with very many links is no hot task. Rounds end when nothing changes;
each is written to the shared checkpoint folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolake.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: the smallest node reachable, for all linked nodes.

    Links may repeat and run in any direction; a link of a node with itself or with a null end
    says nothing and is left out, so a node without other links has no row in the result.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    mark = _mark(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    # all links now run from a node straight to the smallest of its component
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to its smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    moved = edges.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b"))).distinct()


def _mark(edges: DataFrame):
    """Number and checksum of the links: equal marks mean that a round changed nothing."""
    return edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
