"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.groups import rejoined
from corvane.tables import Table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v; each node's neighbours are tied to the smallest of them.

    The smallest neighbour is a pre-aggregated minimum that is joined back on a hash of the
    node, so that Spark can split the rows of a node with very many neighbours among tasks.
    """
    near = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        near = near.unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = near.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
    tied = rejoined(near, least, "x")
    if large:
        return tied.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
    return tied.where("y > m").select(F.col("y").alias("u"), F.col("m").alias("v")).unionAll(least.where("x > m").select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Self-loops, repeated edges and both directions are allowed; edges with a null end are
    ignored; without edges the result is empty. Each round is a written table, and only a
    count and a checksum reach the driver.
    """
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    table, mark = Table(start, "edges"), None
    for _ in range(max_rounds):
        following = Table(_star(_star(table.df, large=True), large=False), "edges")
        table.drop()
        table = following
        row = table.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = table.df
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(star.select("v", "v").distinct())
