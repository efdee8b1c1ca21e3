"""Per-series window transforms.

A series holds one row per step (month or year), so a window task never holds more
than the steps of one series, however many reports went into them. Lags are
positional, by row, unless the months are filled first with ``fill_months``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.joins import beside


def series_window(key: Sequence[str], order: str):
    return Window.partitionBy(*key).orderBy(order)


def pct_change(df: DataFrame, key: Sequence[str], order: str, col: str, name: str = "growth_rate") -> DataFrame:
    """Change on the row before, in per cent of it."""
    before = F.lag(col, 1).over(series_window(key, order))
    return df.withColumn(name, F.try_divide(F.col(col).cast("double") - before, before.cast("double")) * 100)


def lag_columns(
    df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str], n: int, name: str = "{col}"
) -> DataFrame:
    w = series_window(key, order)
    return df.withColumns({name.format(col=c): (F.lag(c, n).over(w) if n else F.col(c)) for c in cols})


def difference(df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str], name: str = "{col}") -> DataFrame:
    w = series_window(key, order)
    return df.withColumns({name.format(col=c): F.col(c) - F.lag(c, 1).over(w) for c in cols})


def rolling_mean(
    df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str], k: int = 4, name: str = "smoothed_{col}"
) -> DataFrame:
    """Right-aligned mean of ``k`` rows; null until the window is full of values."""
    w = series_window(key, order).rowsBetween(-(k - 1), 0)
    return df.withColumns({name.format(col=c): F.when(F.count(c).over(w) == k, F.avg(c).over(w)) for c in cols})


def group_total(df: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """Group sum beside each row.

    Aggregate and join back instead of a window: a group may hold most of the rows,
    the partial sums shrink it before the shuffle and ``beside`` spreads its rows.
    """
    return beside(df, by, {name: F.sum(col)})


def lag_expand(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    cols: Sequence[str],
    lags: Sequence[int],
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per (row, lag) with ``cols`` taken ``lag`` rows earlier; ``keep`` stays as it is.

    All lags come from one window pass, so a loop over lags is a grouping key.
    """
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in key)} " if key else ""
    over = f"OVER ({part}ORDER BY `{order}`)"
    fixed = [f"`{c}`" for c in [*key, order, *keep]]
    shifted = df.selectExpr(
        *fixed, *[f"{f'lag(`{c}`, {n}) {over}' if n else f'`{c}`'} AS `_{n}_{c}`" for n in lags for c in cols]
    )
    entries = ", ".join(
        f"named_struct('lag', {n}, " + ", ".join(f"'{c}', `_{n}_{c}`" for c in cols) + ")" for n in lags
    )
    return shifted.selectExpr(*fixed, f"inline_outer(array({entries}))")


def fill_months(
    df: DataFrame, key: Sequence[str], month: str, cols: Sequence[str], fill: float | None = None
) -> DataFrame:
    """Insert the months missing inside each series; new cells are null or ``fill``.

    Each row spans the gap up to the next one, so no join against a calendar is needed.
    """
    following = F.lead(month, 1).over(series_window(key, month))
    spans = df.select(
        *key,
        F.col(month).alias("_own"),
        *cols,
        F.greatest(F.coalesce(F.add_months(following, -1), F.col(month)), F.col(month)).alias("_last"),
    )
    spread = spans.select(
        *key, "_own", *cols, F.explode_outer(F.sequence("_own", "_last", F.expr("interval 1 month"))).alias(month)
    )
    value = lambda c: F.when(F.col("_own") == F.col(month), F.col(c)).otherwise(F.lit(fill))
    return spread.select(*key, month, *[value(c).alias(c) for c in cols])
