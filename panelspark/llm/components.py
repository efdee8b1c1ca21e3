"""Connected components of an edge table, by large-star and small-star rounds, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node (the larger ones, or the smaller ones and the node) on the smallest of them.

    A node's smallest neighbour is an aggregate with partial sums, joined back to its
    edges; the join can be split where a node has very many.
    """
    if large:
        near = _both_ways(edges)
        least = near.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        joined = near.join(least, near["a"] == least["n"]).where("b > a")
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        # edges point from the larger to the smaller node
        least = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), "low")
        joined = edges.join(least, edges["a"] == least["n"])
        out = joined.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        out = out.select("e.a", "e.b")
    return out.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges`` that isn't the smallest of its component.

    Nulls and loops are left out; repeated and turned edges count once. An edge table
    is written after each round and compared by count and hash; rounds grow with the
    logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    at = materialise(pairs.where("a <> b").distinct(), "components")
    mark = _mark(at)
    while mark[0]:
        at = materialise(_star(_star(at, True), False), "components")
        new = _mark(at)
        if new == mark:
            break
        mark = new
    return at.select(F.col("a").alias("node"), F.col("b").alias("component"))
