"""Joins and set operations.

Spark broadcasts a side below its size threshold, from file sizes at planning time and
from measured shuffle sizes at run time, and sorts and merges otherwise, splitting
skewed partitions of plain joins. Adaptive execution does not split a join whose side
is an aggregate over the join's own shuffle; ``beside`` deals with hot keys there, with
the one broadcast hint, of fewer than ``HOT`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import materialise

#: Groups with more than one row in HOT are hot; there are fewer than HOT of them.
HOT = 10_000


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys in which null equals null; the keys of ``left`` stay, or of ``right`` where ``left`` has no row."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    joined = left.join(other, same, how)
    keys = [F.coalesce(k, f"_r_{k}").alias(k) if how == "full" and k in on else F.col(k) for k in left.columns]
    return joined.select(*keys, *[c for c in right.columns if c not in on])


def beside(df: DataFrame, by: Sequence[str], aggs: dict[str, Column], written: bool = False) -> DataFrame:
    """Aggregates of each row's group beside the row; null is a group as well.

    ``df`` is computed once, into the shared folder, unless the caller says that it is ``written`` already.
    Rows of hot groups meet their aggregates in a broadcast of fewer than HOT rows, so
    they stay where they are; for the shuffle that the other groups need they get a
    key of their own, spread by a salt.
    """
    rows = df if written else materialise(df, "beside")
    every = rows.count()  # from the files' footers
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in aggs.items()])
    keyed = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], F.struct(*aggs).alias("_agg"), (F.col("_rows") * HOT > every).alias("_hot")
    )
    hot = F.broadcast(keyed.where("_hot").drop("_hot"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
    names = [f"_k_{k}" for k in by]
    near = rows.join(hot, same, "left").withColumnRenamed("_agg", "_near").drop(*names)
    if every < HOT:  # then every group is hot
        return near.select(*[c for c in rows.columns if c not in aggs], *[F.col("_near")[n].alias(n) for n in aggs])
    salt = F.when(F.col("_near").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)) + 1).otherwise(F.lit(0))
    cold = keyed.where("NOT _hot").drop("_hot").withColumn("_cell", F.lit(0).cast("long"))
    far = near.withColumn("_salt", salt.cast("long")).join(cold, same & (F.col("_salt") == F.col("_cell")), "left")
    one = F.coalesce("_near", "_agg")
    return far.select(*[c for c in rows.columns if c not in aggs], *[one[n].alias(n) for n in aggs])


def join_inner(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Unmatched rows drop, which also filters (by year, say)."""
    return left.join(right, list(on), "inner")


def join_full(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows of both sides on coalesced keys; a missing key meets a missing one.

    Both sides are aggregates with one row per key, so no key is hot here.
    """
    return join_same(left, right, on, "full")


def join_rolled_denominator(
    panel: DataFrame, denominators: DataFrame, keep: Sequence[str], pops: Sequence[str]
) -> DataFrame:
    """Sum the denominators to the panel's grain (``keep``), then join."""
    rolled = denominators.groupBy(*keep).agg(*[F.sum(p).alias(p) for p in pops])
    return panel.join(rolled, list(keep), "inner")


def attach_scalars(df: DataFrame, source: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """One-row statistics of ``source`` beside every row, as one scalar subquery."""
    one = source.agg(F.struct(*[c.alias(n) for n, c in aggs.items()])).scalar()
    return df.withColumn("_one", one).select(*df.columns, *[F.col("_one")[n].alias(n) for n in aggs])


def join_region_names(
    panel: DataFrame, regions: DataFrame, region: str, spelling: Column, attribute_key: str
) -> DataFrame:
    """Panel with region attributes, after the region takes the attribute table's spelling."""
    renamed = panel.withColumn(region, spelling)
    return renamed.join(regions.withColumnRenamed(attribute_key, region), [region], "inner")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def setdiff(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Labels of ``left`` that ``right`` lacks; null is a label."""
    return left.select(col).subtract(right.select(col))
