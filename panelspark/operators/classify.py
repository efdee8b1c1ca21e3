"""Quantile classes for maps, and the tables behind the maps and line charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import zero_to_null
from panelspark.functions.vocab import ANIMALS, SERIES
from panelspark.operators.ordering import exact_quantiles
from panelspark.operators.rollup import RATE_PAIRS, sum_by
from panelspark.operators.windows import rolling_mean

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def quantile_breaks(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles and maximum, nulls skipped, as an array ``breaks``."""
    return exact_quantiles(df, col, QUARTILES, by, "breaks")


def class_columns(value: str, edges: str, n_edges: int, prefix: str = "class") -> dict[str, Column]:
    """Index and label of the right-closed class, lowest value included.

    ``edges`` is sorted and distinct, with at most ``n_edges`` entries. Null and
    out-of-range values get class 0, label '0'. Both arguments name columns.
    """
    inside = f"{value} BETWEEN element_at({edges}, 1) AND element_at({edges}, -1)"
    above = " + ".join(f"int(coalesce({value} > try_element_at({edges}, {i}), false))" for i in range(2, n_edges))
    index = f"CASE WHEN {inside} THEN 1 + {above} ELSE 0 END"
    low = f"round(try_element_at({edges}, {index}), 2)"
    high = f"round(coalesce(try_element_at({edges}, {index} + 1), element_at({edges}, -1)), 2)"
    label = f"CASE WHEN {inside} THEN format_string('%.2f-%.2f', {low}, {high}) ELSE '0' END"
    return {f"{prefix}_index": F.expr(index), f"{prefix}_label": F.expr(label)}


def quantile_class(df: DataFrame, col: str, prefix: str = "class", breaks: DataFrame | None = None) -> DataFrame:
    """Add class index and label; breaks from ``df`` itself unless given as a one-row table.

    Equal breaks are merged. The breaks are one scalar subquery, so a constant to every row.
    """
    one = breaks if breaks is not None else quantile_breaks(df, col)
    edges = one.select(F.array_distinct("breaks")).scalar()
    columns = class_columns(f"`{col}`", "_edges", len(QUARTILES), prefix)
    return df.withColumn("_edges", edges).withColumns(columns).drop("_edges")


def map_table(yearly: DataFrame, region_names: DataFrame, spelling: Column, names_key: str = "region") -> DataFrame:
    """Region by year: human and animal incidence with their classes, joined to the map's region names.

    ``yearly`` is keyed by (region, year, diagnosis). Human breaks come from the
    region-years; animal breaks are pooled over the four species, zeros left out.
    """
    animal = [f"{s}_incidence" for s in ANIMALS]
    sums = sum_by(yearly, ["region", "year"], list(RATE_PAIRS)).withColumns(
        {c: zero_to_null(F.col(c)) for c in animal}
    )
    # both sets of breaks in one pass: the values carry which set they belong to
    long = sums.unpivot(["region", "year"], ["hum_incidence", *animal], "variable", "value")
    pooled = long.withColumn("kind", F.when(F.col("variable") == "hum_incidence", "human").otherwise("animal"))
    breaks = quantile_breaks(pooled, "value", ["kind"])
    edges = breaks.agg(
        F.struct(
            *[
                F.max(F.when(F.col("kind") == kind, F.array_distinct("breaks"))).alias(kind)
                for kind in ("human", "animal")
            ]
        )
    ).scalar()
    n = len(QUARTILES)
    columns = class_columns("hum_incidence", "_edges.human", n, "human")
    for c in animal:
        found = class_columns(c, "_edges.animal", n)
        columns |= {
            f"value_{c}": F.col(c),
            f"cat_index_{c}": found["class_index"],
            f"cat_label_{c}": found["class_label"],
        }
    # every species has its own columns already, so there is nothing to pivot back
    classed = sums.withColumns({"_edges": edges, "region": spelling}).withColumns(columns)
    return classed.drop("_edges", *animal).join(
        region_names.withColumnRenamed(names_key, "region"), ["region"], "inner"
    )


def smoothed_long(monthly: DataFrame, k: int = 4) -> DataFrame:
    """(month, series, Original or Smoothed, value) from a national monthly panel with rates."""
    rates = [f"{s}_incidence" for s in SERIES]
    smoothed = rolling_mean(monthly.select("month", *rates), [], "month", rates, k).dropna()
    long = smoothed.unpivot(
        ["month"], rates + [f"smoothed_{c}" for c in rates], "variable", "value"
    )
    return long.select(
        "month",
        F.regexp_extract("variable", "(hum|catt|cam|goat|shp)_", 1).alias("series"),
        F.when(F.col("variable").startswith("smoothed"), "Smoothed").otherwise("Original").alias("type"),
        "value",
    )
