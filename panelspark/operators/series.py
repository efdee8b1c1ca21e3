"""Monthly series: build, seasonal table, decomposition, autocorrelation, unit-root statistic.

A series has one row per month. The array forms below hold one series per row; the
months are checked to be unique, so an array is never longer than the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from panelspark.functions.columns import row_sum
from panelspark.functions.local_regression import seasonal_trend
from panelspark.functions.linalg import add_steps, normal_equations, solve_steps
from panelspark.functions.vocab import ANIMALS
from panelspark.operators.joins import join_same
from panelspark.operators.reshape import pivot
from panelspark.operators.windows import series_window
from panelspark.session import reach_workers

# published critical values of the unit-root statistic with constant and trend, large samples
ADF_CRITICAL = {"crit_1": -3.96, "crit_5": -3.41, "crit_10": -3.12}
# FIXED VALUES: published distribution of that statistic, by probability for each number of changes
ADF_SIZES = (25, 50, 100, 250, 500, 100000)
ADF_TABLE = {
    0.01: (-4.38, -4.15, -4.04, -3.99, -3.98, -3.96),
    0.025: (-3.95, -3.80, -3.73, -3.69, -3.68, -3.66),
    0.05: (-3.60, -3.50, -3.45, -3.43, -3.42, -3.41),
    0.10: (-3.24, -3.18, -3.15, -3.13, -3.13, -3.12),
    0.90: (-1.14, -1.19, -1.22, -1.23, -1.24, -1.25),
    0.95: (-0.80, -0.87, -0.90, -0.92, -0.93, -0.94),
    0.975: (-0.50, -0.58, -0.62, -0.64, -0.65, -0.66),
    0.99: (-0.15, -0.24, -0.28, -0.31, -0.32, -0.33),
}


def series_build(
    df: DataFrame,
    key: Sequence[str],
    month: str = "month",
    y: str = "hum_incidence",
    parts: Sequence[str] = tuple(f"{s}_incidence" for s in ANIMALS),
    total: str = "animal_incidence",
    cutoff: str | None = None,
) -> DataFrame:
    """(key, month, y, total): the null-propagating sum of ``parts`` beside ``y``, up to a cutoff.

    Two rows of one series with the same month fail the job.
    """
    if cutoff is not None:
        df = df.where(F.col(month) <= F.lit(cutoff).cast("date"))
    rows = df.select(*key, month, y, row_sum([F.col(c) for c in parts], skip_nulls=False).alias(total))
    twin = F.lag(month, 1).over(series_window(key, month)) == F.col(month)
    checked = F.when(F.coalesce(twin, F.lit(False)), F.raise_error(F.lit("two rows for one month of a series")))
    return rows.withColumn(month, F.coalesce(checked.cast("date"), F.col(month)))


def season_table(df: DataFrame, key: Sequence[str], month: str, value: str, years: Sequence[int] = ()) -> DataFrame:
    """Month of year by year: a column for each of ``years``, or a row for each year there is without them."""
    if not years:
        by = [*key, F.month(month).alias("month_of_year"), F.year(month).alias("year")]
        return df.groupBy(*by).agg(F.sum(value).alias(value))
    parts = df.select(
        *key, F.year(month).alias("_year"), F.month(month).alias("month_of_year"), F.col(value).alias("_value")
    )
    return pivot(parts, [*key, "month_of_year"], "_year", {y: f"y{y}" for y in years}, "_value")


def decompose(
    df: DataFrame, key: Sequence[str], month: str = "month", value: str = "value", period: int = 12
) -> DataFrame:
    """Classical additive decomposition of a gap-free monthly series.

    Trend: the mean of two shifted ``period``-month means; season: mean detrended
    value by month of year, re-centred to 0; remainder: the rest.
    """
    w = series_window(key, month)
    half = period // 2
    frames = [w.rowsBetween(-half, half - 1), w.rowsBetween(-half + 1, half)]
    full = (F.count(value).over(frames[0]) == period) & (F.count(value).over(frames[1]) == period)
    trend = F.when(full, (F.avg(value).over(frames[0]) + F.avg(value).over(frames[1])) / 2)
    rows = (
        df.select(*key, month, F.col(value).cast("double").alias(value))
        .withColumn("trend", trend)
        .withColumn("_month", F.month(month))
    )
    # month-of-year means: twelve rows per series
    means = rows.groupBy(*key, "_month").agg(F.avg(F.col(value) - F.col("trend")).alias("_raw"))
    centred = means.withColumn("season", F.col("_raw") - F.avg("_raw").over(Window.partitionBy(*key))).drop("_raw")
    return (
        join_same(rows, centred, [*key, "_month"])
        .drop("_month")
        .withColumn("remainder", F.col(value) - F.col("trend") - F.col("season"))
    )


def odd(x: float) -> int:
    """The smallest odd number that is not below ``x``."""
    up = int(np.ceil(x))
    return up + 1 - up % 2


def decompose_local(
    df: DataFrame,
    key: Sequence[str],
    month: str = "month",
    value: str = "value",
    period: int = 12,
    season_span: int = 13,
    trend_span: int | None = None,
    inner: int = 2,
    robust: int = 0,
) -> DataFrame:
    """Seasonal-trend decomposition by local regression of a gap-free monthly series: trend, season, remainder.

    The season is smoothed over ``season_span`` years, the trend over ``trend_span`` months (by default the
    shortest that leaves no season in it). ``robust`` rounds weigh months down by the size of their remainder.
    A series is one row while it is fitted; two rows for one month fail the job. Months without a value
    are left out, and a series of fewer than two periods has null components.
    """
    trend_span = trend_span or odd(1.5 * period / (1 - 1.5 / season_span))
    complete = df.where(F.col(month).isNotNull() & F.col(value).isNotNull())
    pair = F.struct(F.col(month), F.col(value).cast("double").alias(value))
    rows = complete.groupBy(*key).agg(F.sort_array(F.collect_list(pair)).alias("_rows"))
    months = F.col("_rows")[month]
    checked = F.when(F.size(F.array_distinct(months)) == F.size(months), F.col("_rows")).otherwise(
        F.raise_error(F.lit("two rows for one month of a series")).cast(rows.schema["_rows"].dataType)
    )
    rows = rows.select(*key, checked.alias("_rows")).select(*key, "_rows", F.col("_rows")[value].alias("_y"))
    parts = ["_trend", "_season"]

    def run(batches):
        for batch in batches:
            made = []
            for y in batch["_y"].to_pylist():
                y = np.array(y, float)
                short = len(y) < 2 * period
                made.append([None] * 2 if short else [p.tolist() for p in seasonal_trend(y, period, season_span, trend_span, odd(period), inner, robust)])
            lists = [pa.array([m[i] for m in made], pa.list_(pa.float64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, *parts])

    schema = rows.select("*").schema
    for name in parts:
        schema = schema.add(name, ArrayType(DoubleType()))
    reach_workers(df.sparkSession)
    fitted = rows.mapInArrow(run, schema)
    cells = F.arrays_zip(
        F.col("_rows")[month].alias(month),
        F.col("_y").alias(value),
        *[F.coalesce(p, F.transform("_y", lambda v: F.lit(None).cast("double"))).alias(p) for p in parts],
    )
    out = fitted.select(*key, F.inline_outer(cells))
    return out.select(*key, month, value, F.col("_trend").alias("trend"), F.col("_season").alias("season")).withColumn(
        "remainder", F.col(value) - F.col("trend") - F.col("season")
    )


def _as_array(df: DataFrame, key: Sequence[str], month: str, cols: Sequence[str]) -> DataFrame:
    """One row per series: centred value arrays in month order, and their length ``n``."""
    complete = df.where(F.col(month).isNotNull()).dropna(subset=list(cols))
    rows = complete.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(month), *[F.col(c).cast("double").alias(c) for c in cols]))).alias(
            "_rows"
        )
    )
    months = F.col("_rows")[month]
    same = F.size(F.array_distinct(months)) == F.size(months)
    rows = rows.withColumn(
        "n",
        F.when(same, F.size("_rows")).otherwise(
            F.raise_error(F.lit("two rows for one month of a series")).cast("int")
        ),
    )
    rows = rows.withColumns({f"_m_{c}": _sum(F.col("_rows")[c]) / F.col("n") for c in cols})

    def centred(c: str) -> Column:
        return F.transform(F.col("_rows")[c], lambda v: v - F.col(f"_m_{c}")).alias(f"_x_{c}")

    return rows.select(*key, "n", *[centred(c) for c in cols])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def default_lag(n: Column) -> Column:
    """floor(10 log10 n), at most n - 1."""
    return F.least(F.floor(F.lit(10.0) * F.log10(n.cast("double"))).cast("int"), n - 1)


def _acf_array(df: DataFrame, key: Sequence[str], month: str, value: str, max_lag: int | None) -> DataFrame:
    rows = _as_array(df, key, month, [value])
    x, n = F.col(f"_x_{value}"), F.col("n")
    top = default_lag(n) if max_lag is None else F.least(F.lit(max_lag), n - 1)
    rows = rows.withColumn("_c0", _dot(x, x)).withColumn("_top", top)
    values = F.transform(
        F.sequence(F.lit(0), F.col("_top")),
        lambda h: F.try_divide(_dot(F.slice(x, F.lit(1), n - h), F.slice(x, h + 1, n - h)), F.col("_c0")),
    )
    return rows.select(*key, "n", values.alias("_acf"))


def acf(
    df: DataFrame, key: Sequence[str], month: str = "month", value: str = "value", max_lag: int | None = None
) -> DataFrame:
    """Autocorrelation (key, lag, acf): mean of the whole series, divisor n; gap-free months expected."""
    return _acf_array(df, key, month, value, max_lag).select(*key, F.posexplode_outer("_acf").alias("lag", "acf"))


def pacf(
    df: DataFrame, key: Sequence[str], month: str = "month", value: str = "value", max_lag: int | None = None
) -> DataFrame:
    """Partial autocorrelation (key, lag, pacf) by the Durbin-Levinson recursion."""
    rows = _acf_array(df, key, month, value, max_lag).withColumn("_rho", F.slice("_acf", 2, F.size("_acf")))
    empty = F.array().cast("array<double>")
    rho = F.col("_rho")

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        before = F.slice(rho, F.lit(1), k - 1)
        new = F.try_divide(
            F.element_at(rho, k) - _dot(phi, F.reverse(before)), F.lit(1.0) - _dot(phi, before)
        )
        # the one-element transform evaluates the new coefficient once
        return F.transform(
            F.array(new),
            lambda v: F.struct(
                F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - v * b), F.array(v)).alias("phi"),
                F.concat(state["out"], F.array(v)).alias("out"),
            ),
        )[0]

    values = F.aggregate(
        F.sequence(F.lit(1), F.size(rho)),
        F.struct(empty.alias("phi"), empty.alias("out")),
        step,
        lambda state: state["out"],
    )
    found = F.when(F.size(rho) > 0, values)
    return rows.select(*key, F.posexplode_outer(found).alias("lag", "pacf")).withColumn("lag", F.col("lag") + 1)


def ccf(
    df: DataFrame, key: Sequence[str], x: str, y: str, max_lag: int = 12, month: str = "month"
) -> DataFrame:
    """Cross-correlation (key, lag, ccf) of x at t + lag with y at t, for -max_lag to max_lag."""
    rows = _as_array(df, key, month, [x, y])
    a, b, n = F.col(f"_x_{x}"), F.col(f"_x_{y}"), F.col("n")
    rows = rows.withColumn("_scale", F.sqrt(_dot(a, a) * _dot(b, b))).withColumn(
        "_top", F.least(F.lit(max_lag), n - 1)
    )

    def at(h: Column) -> Column:
        size = n - F.abs(h)
        lead = F.slice(a, F.greatest(h, F.lit(0)) + 1, size)
        base = F.slice(b, F.greatest(-h, F.lit(0)) + 1, size)
        return F.struct(h.alias("lag"), F.try_divide(_dot(lead, base), F.col("_scale")).alias("ccf"))

    return rows.select(*key, F.inline_outer(F.transform(F.sequence(-F.col("_top"), F.col("_top")), at)))


def interpolate(x: str, xs: Sequence[str], ys: Sequence[str]) -> str:
    """Expression of the broken line through the points (ascending in ``xs``) at ``x``; beyond the ends, the value of the end."""
    parts = [f"WHEN {x} IS NULL THEN NULL WHEN {x} <= {xs[0]} THEN {ys[0]}"]
    for i in range(1, len(xs)):
        share = f"({x} - {xs[i - 1]}) / ({xs[i]} - {xs[i - 1]})"
        parts.append(f"WHEN {x} <= {xs[i]} THEN {ys[i - 1]} + ({ys[i]} - {ys[i - 1]}) * {share}")
    return f"CASE {' '.join(parts)} ELSE {ys[-1]} END"


def adf_p_value(statistic: str, changes: str) -> Column:
    """Probability of a lower statistic, between the tabled sample sizes and then between the tabled probabilities (0.01 to 0.99)."""
    size, number = f"CAST({changes} AS DOUBLE)", lambda v: f"({float(v)!r}D)"
    sizes = [number(n) for n in ADF_SIZES]
    cuts = ", ".join(interpolate(size, sizes, [number(v) for v in row]) for row in ADF_TABLE.values())
    line = interpolate(f"`{statistic}`", [f"c[{i}]" for i in range(len(ADF_TABLE))], [number(p) for p in ADF_TABLE])
    # the one-element transform evaluates the cuts once
    return F.expr(f"transform(array(array({cuts})), c -> {line})[0]")


def adf(
    df: DataFrame,
    key: Sequence[str],
    month: str = "month",
    value: str = "value",
    k: int | None = None,
    k_max: int | None = None,
) -> DataFrame:
    """Unit-root regression: change on constant, trend, level before and ``k`` lagged changes.

    ``k`` defaults to trunc((n - 1)^(1/3)) of each series. The longest series, found
    first, sets how many lag columns there are unless ``k_max`` does; with it, a series
    that needs more fails. Unused lag columns are 0 and drop out of the fit. ``p_value``
    comes from the published table, at 0.01 and 0.99 beyond its ends.
    """
    if k is not None:
        k_max = k
    elif k_max is None:
        sizes = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        k_max = int(((sizes.agg(F.max("n")).first()[0] or 1) - 1) ** (1 / 3) + 1e-9)
    w = series_window(key, month)
    size = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = (
        df.select(*key, month, F.col(value).cast("double").alias("_y"))
        .where(F.col("_y").isNotNull())
        .withColumns(
            {
                "_t": (F.row_number().over(w) - 1).cast("double"),
                "_level": F.lag("_y", 1).over(w),
                "_n": size,
            }
        )
    )
    wanted = F.lit(k) if k is not None else F.floor(F.pow((F.col("_n") - 1).cast("double"), F.lit(1 / 3)) + 1e-9)
    rows = rows.withColumn("_k", wanted.cast("int")).withColumn("_d", F.col("_y") - F.col("_level"))
    rows = rows.withColumn(
        "_k",
        F.when(F.col("_k") <= k_max, F.col("_k")).otherwise(
            F.raise_error(F.lit("series too long for k_max")).cast("int")
        ),
    )
    lags = {
        f"_d{j}": F.when(F.lit(j) <= F.col("_k"), F.lag("_d", j).over(w)).otherwise(F.lit(0.0))
        for j in range(1, k_max + 1)
    }
    rows = rows.withColumns(lags).where(F.col("_t") > F.col("_k"))
    xs = ["_level", "_t", *lags]
    moments = normal_equations(rows, key, "_d", xs, extra=[F.max("_k").alias("k"), (F.max("_n") - 1).alias("_changes")])
    solved = add_steps(moments, solve_steps(xs, "_fit"))
    gamma, se = F.element_at("_fit.coef", 2), F.element_at("_fit.se", 2)
    solved = solved.withColumn("statistic", F.try_divide(gamma, se))
    return solved.select(
        *key,
        F.col("n").alias("n_used"),
        "k",
        gamma.alias("gamma"),
        "statistic",
        adf_p_value("statistic", "_changes").alias("p_value"),
        *[F.lit(v).alias(c) for c, v in ADF_CRITICAL.items()],
    )
