"""Connected components of an undirected graph by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest node it can see from there."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    # Staged, so that the join has an exchange on either side and a star's centre can be split among tasks.
    low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, move to the smallest of them; edges come as (larger, smaller)."""
    edges = stage(edges, "large-stars")
    low = stage(edges.groupBy("a").agg(F.min("b").alias("m")), "lowest")
    moved = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``, any order, repeats and loops allowed).

    The component is its smallest node. Rounds end when the edges are stars that no longer change; each round is written to
    the shared folder, so a lost executor costs one round. Nodes keep one row per edge throughout, also those with very many
    edges. No edges give no rows; edges with a null end are left out.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b and a is not null and b is not null").distinct(), "edges")
    seen = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
