"""Pearson correlations, plain and lagged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.windows import lag_expand


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Long matrix (var_1, var_2, r), one aggregate for all pairs.

    ``strict``: a null in either column makes the entry null; otherwise pairs with
    a null are skipped.
    """
    cols = list(cols)

    def entry(a: str, b: str) -> str:
        # the built-in corr raises on a constant column in ANSI mode; here that entry is null
        x, y = f"`{a}`", f"`{b}`"
        if not strict:
            x, y = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
        spread = f"sqrt(var_pop({x})) * sqrt(var_pop({y}))"
        r = f"try_divide(covar_pop({x}, {y}), {spread})" if a != b else f"CASE WHEN {spread} > 0 THEN 1D END"
        return f"CASE WHEN count(`{a}`) = count(1) AND count(`{b}`) = count(1) THEN {r} END" if strict else r

    span = range(len(cols))
    wide = df.groupBy(*by).agg(
        *[F.expr(entry(cols[i], cols[j])).alias(f"_r{i}_{j}") for i in span for j in span if j >= i]
    )
    entries = ", ".join(
        f"named_struct('var_1', '{cols[i]}', 'var_2', '{cols[j]}', 'r', _r{min(i, j)}_{max(i, j)})"
        for i in span
        for j in span
    )
    return wide.selectExpr(*[f"`{k}`" for k in by], f"inline_outer(array({entries}))")


def lagged_corr(
    df: DataFrame, order: str, y: str, xs: Sequence[str], max_lag: int = 6, key: Sequence[str] = ()
) -> DataFrame:
    """Correlation matrix for each lag of ``xs`` from 0 to ``max_lag``.

    Lags above 0 keep rows complete in all columns; lag 0 keeps every row, so a
    null there makes its entries null.
    """
    rows = lag_expand(df, key, order, xs, range(max_lag + 1), keep=[y])
    complete = " AND ".join(f"`{c}` IS NOT NULL" for c in [y, *xs])
    return corr_matrix(rows.where(f"lag = 0 OR ({complete})"), [y, *xs], [*key, "lag"])


def avg_abs_corr(matrix: DataFrame, y: str, key: Sequence[str] = ()) -> DataFrame:
    """Mean absolute correlation of ``y`` with the other variables, per lag."""
    return (
        matrix.where((F.col("var_1") == y) & (F.col("var_2") != y))
        .groupBy(*key, "lag")
        .agg(F.avg(F.abs("r")).alias("avg_abs_cor"))
    )
