"""Row-level and column-set transforms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.joins import beside
from panelspark.operators.ordering import dense_codes


def conform(df: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """Select ``{new name: old name or expression}``; the raw layouts meet on one schema this way."""
    return df.select(
        *[(F.col(f"`{src}`") if isinstance(src, str) else src).alias(new) for new, src in mapping.items()]
    )


def cols_like(
    df: DataFrame,
    contains: str | None = None,
    *,
    prefix: str | None = None,
    exclude: str | None = None,
    dtype: str | Sequence[str] | None = None,
) -> list[str]:
    """Column names by part, prefix, absent part and type."""
    kinds = [dtype] if isinstance(dtype, str) else dtype
    return [
        name
        for name, kind in df.dtypes
        if (contains is None or contains in name)
        and (prefix is None or name.startswith(prefix))
        and (exclude is None or exclude not in name)
        and (kinds is None or kind in kinds)
    ]


def across(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column], name: str = "{col}") -> DataFrame:
    """Apply one expression to many columns in one projection."""
    return df.withColumns({name.format(col=c): fn(F.col(c)) for c in cols})


def filter_in(df: DataFrame, col: str, values: Sequence, keep: bool = True) -> DataFrame:
    """Rows whose value is listed; with ``keep=False`` the others, null included."""
    hit = F.col(col).isin(list(values))
    return df.where(hit) if keep else df.where(F.coalesce(~hit, F.lit(True)))


def filter_present(df: DataFrame, month: str, region: str) -> DataFrame:
    return df.where(F.col(month).isNotNull() & (F.col(region) != ""))


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(cols) if cols else None)


def date_cutoff(df: DataFrame, month: str, cutoff: str, after: bool = False) -> DataFrame:
    """Months up to the cutoff, or strictly after it."""
    limit = F.lit(cutoff).cast("date")
    return df.where(F.col(month) > limit) if after else df.where(F.col(month) <= limit)


def rate_columns(df: DataFrame, pairs: dict[str, tuple[str, str]], per: float = 1e6) -> DataFrame:
    """``{result: (cases, population)}`` as rates."""
    rates = [f"try_divide(double(`{c}`), double(`{p}`)) * {float(per)}D AS `{new}`" for new, (c, p) in pairs.items()]
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in pairs], *rates)


def backcast(
    df: DataFrame, base: str, growth: str, base_year: int, steps: int, year: str = "year", value: str = "pop"
) -> DataFrame:
    """Base-year values carried back: each earlier year shrinks by the growth rate and is rounded.

    Rounding is half to even at every step, so a step depends on the one after it.
    """
    shrink = F.lit(1.0) - F.col(growth) / F.lit(100.0)
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.array(F.col(base).cast("double")),
        lambda acc, _: F.concat(acc, F.array(F.bround(F.element_at(acc, -1) * shrink, 0))),
    )
    keep = [c for c in df.columns if c not in (base, growth)]
    return df.select(*keep, F.posexplode_outer(path).alias("_back", value)).select(
        *keep, (F.lit(base_year) - F.col("_back")).alias(year), value
    )


def replace_outliers(
    df: DataFrame, limits: Sequence[tuple[str, float, str]], mean_of: str | dict[str, str] = "all"
) -> DataFrame:
    """Values beyond a limit become the rounded mean.

    ``mean_of="all"`` takes the mean over all rows, outliers included; ``"below"``
    over the rows under the limit; a dictionary says which for each column. The means of all columns come from one
    aggregate, used as a scalar subquery.
    """

    def beyond(col: str, limit: float, op: str) -> Column:
        return F.col(col) >= F.lit(limit) if op == ">=" else F.col(col) > F.lit(limit)

    means = [
        (F.avg(c) if (mean_of if isinstance(mean_of, str) else mean_of[c]) == "all" else F.avg(F.when(F.col(c) < F.lit(limit), F.col(c)))).alias(c)
        for c, limit, _ in limits
    ]
    pool = df.agg(F.struct(*means).alias("means")).scalar()
    return df.withColumn("_means", pool).withColumns(
        {
            c: F.when(beyond(c, limit, op), F.bround(F.col("_means")[c], 0)).otherwise(F.col(c).cast("double"))
            for c, limit, op in limits
        }
    ).drop("_means")


def factor_codes(df: DataFrame, col: str, code: str, by: Sequence[str] = ()) -> DataFrame:
    """1-based code of a label in sort order, overall or within ``by``.

    Only the distinct labels are ranked; the codes are joined back, so a hot
    label costs nothing extra.
    """
    codes = dense_codes(df, col, by).withColumnRenamed("code", code)
    return df.join(codes, [*by, col], "left")


def step_codes(df: DataFrame, key: Sequence[str], order: str, code: str) -> DataFrame:
    """1-based code of each step within its series; equal steps share a code."""
    return df.withColumn(code, F.dense_rank().over(Window.partitionBy(*key).orderBy(order)))


def holdout(df: DataFrame, key: Sequence[str], order: str, frac: float = 0.8) -> DataFrame:
    """Mark the first ``floor(frac * n)`` rows of each series as ``train``, the rest as ``test``.

    A series holds one row per month, so a window task holds one series' months.
    """
    w = Window.partitionBy(*key)
    return (
        df.withColumn("idx", F.row_number().over(w.orderBy(order)))
        .withColumn("n_rows", F.count(F.lit(1)).over(w))
        .withColumn(
            "part", F.when(F.col("idx") <= F.floor(F.col("n_rows") * F.lit(frac)), "train").otherwise("test")
        )
    )


def standardise(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Centre and scale to mean 0 and sample deviation 1; a constant column becomes null."""
    named = {f"_m_{c}": F.avg(c) for c in cols} | {f"_s_{c}": F.stddev_samp(c) for c in cols}
    moments = [c.alias(n) for n, c in named.items()]
    if by:
        joined = beside(df, by, named)
        mean, dev = (lambda c: F.col(f"_m_{c}")), (lambda c: F.col(f"_s_{c}"))
    else:
        joined = df.withColumn("_mom", df.agg(F.struct(*moments)).scalar())
        mean, dev = (lambda c: F.col("_mom")[f"_m_{c}"]), (lambda c: F.col("_mom")[f"_s_{c}"])
    return joined.withColumns({c: F.try_divide(F.col(c) - mean(c), dev(c)) for c in cols}).drop(
        "_mom", *[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols]
    )


def row_index(df: DataFrame, key: Sequence[str], order: str, name: str = "idx") -> DataFrame:
    """Running number within a series; one row per month keeps each window small."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(order)))
