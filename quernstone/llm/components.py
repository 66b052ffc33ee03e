"""Connected components of an edge table by alternating large-star and small-star steps, all distributed.

Every step is a minimum per node (combined before the shuffle) and an equi-join with it, in which nodes of very many edges are joined by
broadcast (they are few, see grouped()), so no task grows with a hub. Edges are cut from their lineage after each round by a table in the
shared folder. Rounds end when one changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quernstone.llm.common import HEAVY, discard, grouped, stored


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a > b").distinct()


def _large_star(edges: DataFrame, total: int, heavy: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    larger = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    return _distinct(grouped(larger, least, ["u"], 2 * total, heavy).select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, total: int, heavy: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = grouped(edges, least, ["a"], total, heavy).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(moved.union(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(node, root) for each node of edges (a long, b long); root is the smallest node of its component.

    Null ends and loops are ignored; repeated edges count once. Nodes without an edge have no row."""
    edges = stored(_distinct(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null")))
    n, settled = edges.count(), False
    while n and not settled:
        larger = stored(_large_star(edges, n, heavy))
        now = stored(_small_star(larger, larger.count(), heavy))
        m = now.count()
        settled = m == n and now.join(edges, ["a", "b"], "left_anti").isEmpty()
        discard(larger, edges)
        edges, n = now, m
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
