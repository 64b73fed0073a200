"""Connected components of an edge table by alternating star contractions, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidpath.llm.common import hot_lookup, stage

#: A node with so many edges fits any task.
HOT_ROWS = 100_000


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _met(rows: DataFrame, least: DataFrame, n_rows: int, name: str) -> DataFrame:
    """``rows`` (u, v) with the fact m of each u; only if some u has a large part of all rows is it met by broadcast."""
    least = stage(least, f"{name}-least")
    most = least.agg(F.max("n")).first()[0] or 0
    if most <= max(HOT_ROWS, n_rows // 1000):
        return rows.join(least, "u")
    return hot_lookup(rows, least, "u", "n", n_rows)


def _large_star(edges: DataFrame, n_edges: int, name: str) -> DataFrame:
    """Every neighbour of u that is larger than u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    links = _met(both.filter("v > u"), least, 2 * n_edges, name)
    return stage(_distinct(links.select(F.col("v").alias("u"), F.col("m").alias("v"))), name)


def _small_star(edges: DataFrame, n_edges: int, name: str) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them; u is already the larger end of each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    links = _met(edges, least, n_edges, name).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stage(_distinct(links.unionByName(least.select("u", F.col("m").alias("v")))), name)


def _done(edges: DataFrame) -> bool:
    """Whether each node has one edge at most to a smaller one, which has none."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """From edges (u, v) the rows (id, component): every node of an edge that isn't the least of its component.

    A node with a large part of all edges, as the least of a giant component comes to be, meets them by broadcast.
    """
    edges = stage(_distinct(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), name)
    while not _done(edges):
        n_edges = edges.count()
        edges = _small_star(_large_star(edges, n_edges, name), n_edges, name)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
