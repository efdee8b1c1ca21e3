"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    names: dict[str, str],
    value: str | Column,
    fill: float | None = None,
) -> DataFrame:
    """Long to wide with an explicit ``{value of col: output column}``; absent cells are null or ``fill``.

    Conditional sums, so one partial-and-final aggregate with one shuffle on the
    keys; a hot key is collapsed before the shuffle.
    """
    source = F.col(value) if isinstance(value, str) else value
    cells = {new: F.sum(F.when(F.col(col) == label, source)) for label, new in names.items()}
    if fill is not None:
        cells = {new: F.coalesce(c, F.lit(fill)) for new, c in cells.items()}
    return df.groupBy(*keys).agg(*[c.alias(new) for new, c in cells.items()])


def pivot_multi(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    names: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Several value columns at once, named ``value_name``; one value per cell expected."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(col) == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in names]
    )


def year_spine(df: DataFrame, first: int, last: int, name: str = "year") -> DataFrame:
    """Repeat each row for every year of the range; no join involved."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last))))
