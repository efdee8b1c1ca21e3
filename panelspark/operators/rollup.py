"""Aggregates: sums, multi-grain roll-ups, descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import comma, count_with_share
from panelspark.functions.vocab import POPULATION_OF, SERIES, SERIES_DISPLAY
from panelspark.operators.rows import rate_columns
from panelspark.operators.windows import pct_change

CASES = [f"{s}_cases" for s in SERIES]
POPS = list(POPULATION_OF.values())
RATE_PAIRS = {f"{s}_incidence": (f"{s}_cases", POPULATION_OF[s]) for s in SERIES}

# FIXED VALUES: the names of the published panels, and the keys of each out of (region, year, month, diagnosis)
GRAINS: dict[str, tuple[str, ...]] = {
    "ah2": ("region", "month", "year"),
    "kenya_ah": ("month", "year", "diagnosis"),
    "kenya_ah2": ("month", "year"),
    "yah": ("region", "year", "diagnosis"),
    "yah2": ("region", "year"),
    "kenya_yah": ("year", "diagnosis"),
    "kenya_yah2": ("year",),
}
PANEL_KEYS = ("region", "year", "month", "diagnosis")


def sum_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Null-skipping sums; a group without values gives 0."""
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols])


def rollup_counts(panel: DataFrame, cols: Sequence[str] = CASES) -> DataFrame:
    """The base panel summed to all seven coarser grains in one pass, labelled by ``grain``.

    Rows are told apart by grouping id and not by null keys, as the panel's own
    keys and counts may be null.
    """
    width = len(PANEL_KEYS)
    ids = {
        name: sum(1 << (width - 1 - i) for i, k in enumerate(PANEL_KEYS) if k not in keys)
        for name, keys in GRAINS.items()
    }
    sets = [[F.col(k) for k in keys] for keys in GRAINS.values()]
    sums = panel.groupingSets(sets, *[F.col(k) for k in PANEL_KEYS]).agg(
        F.grouping_id(*PANEL_KEYS).alias("_gid"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols],
    )
    label = F.lit(None).cast("string")
    for name, gid in ids.items():
        label = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(label)
    return sums.withColumn("grain", label).drop("_gid")


def panel_rollup(panel: DataFrame, denominators: DataFrame) -> DataFrame:
    """All coarser panels with denominators of their own grain and rates, in one table.

    ``denominators`` is keyed by (region, year). National rows meet the yearly
    totals, which come from the same grouping-sets aggregate as the regional ones.
    """
    counts = rollup_counts(panel)
    pops = (
        denominators.groupingSets([[F.col("region"), F.col("year")], [F.col("year")]], F.col("region"), F.col("year"))
        .agg(F.grouping("region").alias("_national"), *[F.sum(p).alias(p) for p in POPS])
        .withColumn("region", F.when(F.col("_national") == 0, F.col("region")).otherwise(F.lit("")))
    )
    regional = [name for name, keys in GRAINS.items() if "region" in keys]
    keyed = counts.withColumn("_national", F.when(F.col("grain").isin(regional), 0).otherwise(1).cast("tinyint"))
    joined = keyed.withColumn("_region", F.when(F.col("_national") == 0, F.col("region")).otherwise(F.lit(""))).join(
        pops.withColumnRenamed("region", "_region"), ["_national", "_region", "year"], "inner"
    )
    return rate_columns(joined, RATE_PAIRS).select("grain", *PANEL_KEYS, *CASES, *POPS, *RATE_PAIRS)


def grain(rolled: DataFrame, name: str) -> DataFrame:
    """One panel out of the rolled table, with its own keys only."""
    return rolled.where(F.col("grain") == name).drop("grain", *[k for k in PANEL_KEYS if k not in GRAINS[name]])


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, minimum, median, maximum and sample deviation.

    Meant for yearly sums, so a group holds one value per year; for groups without
    such a bound take the median from ``ordering.exact_quantiles``.
    """
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.median(value).alias("median"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("sd"),
    )


def share_of_total(df: DataFrame, by: Sequence[str], cls: str, value: str) -> DataFrame:
    """Each class's share of its group's total; an empty total gives 0.

    The window runs over the sums, a few classes per group.
    """
    sums = df.groupBy(*by, cls).agg(F.sum(value).cast("double").alias(value))
    total = F.sum(value).over(Window.partitionBy(*by))
    return sums.withColumn("total", total).withColumn(
        "share", F.coalesce(F.try_divide(F.col(value), F.col("total")), F.lit(0.0))
    )


def annual_average(df: DataFrame, by: Sequence[str], year: str, value: str) -> DataFrame:
    """Total divided by the number of distinct years; yearly sums first, so no distinct count is needed."""
    yearly = df.groupBy(*by, year).agg(F.sum(value).alias("_v"))
    return yearly.groupBy(*by).agg(
        F.sum("_v").cast("double").alias("total"),
        F.count(F.lit(1)).alias("years"),
        F.try_divide(F.sum("_v").cast("double"), F.count(F.lit(1)).cast("double")).alias("average"),
    )


def first_by(df: DataFrame, by: Sequence[str], cols: Sequence[str], order: str | Column) -> DataFrame:
    """The value at the lowest ``order`` per group."""
    return df.groupBy(*by).agg(*[F.min_by(c, order).alias(c) for c in cols])


def mean_growth(df: DataFrame, region: str, year: str, value: str, digits: int = 2) -> DataFrame:
    """Mean year-on-year growth per region, in per cent."""
    return (
        pct_change(df, [region], year, value, "_g")
        .groupBy(region)
        .agg(F.bround(F.avg("_g"), digits).alias("growth_rate"))
    )


def case_summary(panel: DataFrame, diagnoses: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Per series: total, annual average, count and share of each diagnosis.

    ``panel`` has year, diagnosis and the five case columns; ``diagnoses`` maps a
    diagnosis to its column stem. One pass over the panel for everything.
    """
    long = (
        sum_by(panel, [*by, "year", "diagnosis"], CASES)
        .unpivot([*by, "year", "diagnosis"], CASES, "variable", "value")
        .withColumn("value", F.col("value").cast("double"))
    )
    per_year = long.groupBy(*by, "variable", "year").agg(
        F.sum("value").alias("_v"),
        *[
            F.coalesce(F.sum(F.when(F.col("diagnosis") == d, F.col("value"))), F.lit(0.0)).alias(f"{stem}_cases")
            for d, stem in diagnoses.items()
        ],
    )
    totals = per_year.groupBy(*by, "variable").agg(
        F.sum("_v").alias("total_cases"),
        F.try_divide(F.sum("_v"), F.count(F.lit(1)).cast("double")).alias("average_cases"),
        *[F.sum(f"{stem}_cases").alias(f"{stem}_cases") for stem in diagnoses.values()],
    )
    return totals.withColumns(
        {
            f"{stem}_share": F.coalesce(F.try_divide(F.col(f"{stem}_cases"), F.col("total_cases")), F.lit(0.0))
            for stem in diagnoses.values()
        }
    ).withColumn("variable", F.regexp_replace("variable", "_cases$", ""))


def incidence_summary(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Descriptive figures of the yearly sums of incidence, per series."""
    rates = list(RATE_PAIRS)
    long = sum_by(panel, [*by, "year"], rates).unpivot([*by, "year"], rates, "variable", "value")
    return describe(long, [*by, "variable"], "value").withColumn(
        "variable", F.regexp_replace("variable", "_incidence$", "")
    )


def summary_table(
    case_panel: DataFrame, rate_panel: DataFrame, diagnoses: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Case and incidence descriptions joined by series (and region), series named for display."""
    both = case_summary(case_panel, diagnoses, by).join(incidence_summary(rate_panel, by), [*by, "variable"])
    names = F.create_map(*[F.lit(x) for pair in SERIES_DISPLAY.items() for x in pair])
    return both.withColumn("species", F.try_element_at(names, F.col("variable"))).drop("variable")


def present_summary(table: DataFrame, diagnoses: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """The published form: thousands separators, counts with shares, two decimals.

    The average is taken of the total as shown, in whole cases.
    """
    total, years = F.col("total_cases"), F.try_divide(F.col("total_cases"), F.col("average_cases"))
    average = F.coalesce(F.try_divide(F.bround(total, 0), years), F.lit(0.0))
    return table.select(
        *by,
        F.col("species").alias("Species"),
        comma(total).alias("Total cases"),
        comma(average, 1).alias("Average cases"),
        *[count_with_share(F.col(f"{stem}_cases"), total).alias(d) for d, stem in diagnoses.items()],
        comma(F.col("mean"), 2).alias("Mean incidence rate"),
        F.round("min", 2).alias("Minimum incidence rate"),
        F.round("median", 2).alias("Median incidence rate"),
        F.round("max", 2).alias("Maximum incidence rate"),
        F.round("sd", 2).alias("SD of incidence rate"),
    )
