"""Lagged least squares for any number of series and lags in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import nan_to
from panelspark.functions.linalg import add_steps, normal_equations, pooled_steps, solve_steps
from panelspark.functions.tails import t_two_sided_p
from panelspark.functions.vocab import TERM_DISPLAY
from panelspark.operators.joins import join_same
from panelspark.operators.windows import difference, lag_expand

INDIVIDUAL, COMBINED = "Individual", "Combined"
# z for the 90 % limits of the coefficient table
Z_90 = 1.645


@dataclass(frozen=True)
class Spec:
    """A lagged regression of ``y`` on ``xs`` and, pooled, on their sum."""

    y: str = "hum_incidence"
    xs: tuple[str, ...] = ("cam_incidence", "shp_incidence", "catt_incidence", "goat_incidence")
    total: str = "animal_incidence"
    lags: tuple[int, ...] = field(default=tuple(range(7)))
    diff: bool = True


def lag_design(df: DataFrame, key: Sequence[str], order: str, spec: Spec) -> DataFrame:
    """Rows (key, order, lag, y, xs): NaN and null to 0, differenced, predictors lagged, complete."""
    cols = [spec.y, *spec.xs]
    filled = df.select(*key, order, *[nan_to(F.col(c).cast("double")).alias(c) for c in cols])
    if spec.diff:
        filled = difference(filled, key, order, cols).dropna(subset=cols)
    return lag_expand(filled, key, order, spec.xs, spec.lags, keep=[spec.y]).dropna(subset=cols)


def common_sample(design: DataFrame, key: Sequence[str], order: str, lags: Sequence[int]) -> DataFrame:
    """Only the rows that every lag has, so that criteria of different lags compare."""
    shared = Window.partitionBy(*key, order)
    return design.withColumn("_k", F.count(F.lit(1)).over(shared)).where(F.col("_k") == len(lags)).drop("_k")


def fit_ols(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with intercept per group: the model table (by, n, terms, coef, se, rank, sse, sst).

    A predictor that depends on earlier ones has a null coefficient and lowers the rank.
    """
    solved = add_steps(normal_equations(df, by, y, xs), solve_steps(xs, "_fit"))
    return solved.select(*by, "n", "_fit.*")


def fit_lagged(design: DataFrame, key: Sequence[str], spec: Spec) -> DataFrame:
    """Both specifications for every key and lag from one aggregate.

    The normal equations of the summed predictor follow from those of its parts,
    so the design is read once.
    """
    k = len(spec.xs)
    steps = {**pooled_steps(k, "t"), **solve_steps(spec.xs, "_ind"), **solve_steps([spec.total], "_all", "t")}
    both = add_steps(normal_equations(design, [*key, "lag"], spec.y, spec.xs), steps)
    stacked = F.array(
        F.struct(F.lit(INDIVIDUAL).alias("model"), "_ind.*"), F.struct(F.lit(COMBINED).alias("model"), "_all.*")
    )
    return both.select(*key, "lag", "n", F.inline_outer(stacked))


def lagged_ols(
    df: DataFrame, order: str, spec: Spec = Spec(), key: Sequence[str] = (), shared: bool = False
) -> DataFrame:
    """Both specifications for every key and lag; with ``shared``, each lag on the rows that all lags have."""
    design = lag_design(df, key, order, spec)
    if shared:
        design = common_sample(design, key, order, spec.lags)
    return fit_lagged(design, key, spec)


def fit_stats(models: DataFrame) -> DataFrame:
    """Add R squared, adjusted R squared and the information criterion n ln(sse/n) + 2 (k + 1)."""
    n, rank = F.col("n").cast("double"), F.col("rank").cast("double")
    r2 = F.lit(1.0) - F.try_divide(F.col("sse"), F.col("sst"))
    return models.withColumns(
        {
            "r_squared": r2,
            "adj_r_squared": F.lit(1.0) - (F.lit(1.0) - r2) * F.try_divide(n - 1, n - rank),
            "aic": n * F.ln(F.try_divide(F.col("sse"), n)) + 2 * (rank + 1),
        }
    )


def coef_table(models: DataFrame, keys: Sequence[str], digits: int | None = 3) -> DataFrame:
    """One row per coefficient, with limits at 1.645 standard errors and fit statistics.

    With ``digits`` the figures are rounded first, and a term is significant when
    its rounded limits have the same sign.
    """
    pairs = F.arrays_zip(F.col("terms"), F.col("coef"), F.col("se"))
    rows = fit_stats(models).select(
        *keys, "n", "rank", "r_squared", "aic", "adj_r_squared", F.posexplode_outer(pairs).alias("position", "_t")
    )
    rows = rows.select(
        "*", F.col("_t.terms").alias("term"), F.col("_t.coef").alias("estimate"), F.col("_t.se").alias("std_error")
    )
    statistic = F.try_divide(F.col("estimate"), F.col("std_error"))
    rows = rows.withColumn("statistic", statistic).withColumns(
        {
            "p_value": t_two_sided_p("statistic", "n - rank"),
            "conf_low": F.col("estimate") - F.lit(Z_90) * F.col("std_error"),
            "conf_high": F.col("estimate") + F.lit(Z_90) * F.col("std_error"),
        }
    )
    shown = ["estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high", "adj_r_squared"]
    if digits is not None:
        rows = rows.withColumns({c: F.bround(F.col(c), digits) for c in shown})
    flag = F.when(F.col("conf_low") * F.col("conf_high") > 0, "Significant").otherwise("Not Significant")
    return rows.withColumn("significance", F.when(F.col("std_error").isNotNull(), flag)).select(
        *keys,
        "position",
        "term",
        "estimate",
        "std_error",
        "statistic",
        "p_value",
        "conf_low",
        "conf_high",
        "r_squared",
        "aic",
        "adj_r_squared",
        "significance",
    )


def display_terms(coefs: DataFrame) -> DataFrame:
    """Add ``variable``, the term's display name."""
    names = F.create_map(*[F.lit(x) for pair in TERM_DISPLAY.items() for x in pair])
    return coefs.withColumn("variable", F.coalesce(F.try_element_at(names, F.col("term")), F.col("term")))


def forest_table(coefs: DataFrame) -> DataFrame:
    """The slopes of both specifications."""
    return display_terms(coefs).where(F.col("term") != "(Intercept)")


def rank_models(stats: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Place of each (key, lag) by information criterion, best first."""
    w = Window.partitionBy(*key).orderBy(F.col("aic").asc_nulls_last(), "lag")
    return stats.withColumn("place", F.row_number().over(w))


def predict(coef: Column, xs: Sequence[Column]) -> Column:
    """Intercept plus slopes; a dropped predictor adds nothing."""
    out = F.element_at(coef, 1)
    for i, x in enumerate(xs):
        out = out + F.coalesce(F.element_at(coef, i + 2), F.lit(0.0)) * x
    return out


def fitted(design: DataFrame, models: DataFrame, key: Sequence[str], spec: Spec) -> DataFrame:
    """Fitted values and residuals of both specifications, on the scale of the design."""
    sides = models.select(*key, "lag", "model", "coef")
    rows = join_same(design, sides, [*key, "lag"])
    xs = [F.col(x) for x in spec.xs]
    whole = xs[0]
    for x in xs[1:]:
        whole = whole + x
    value = F.when(F.col("model") == INDIVIDUAL, predict(F.col("coef"), xs)).otherwise(
        predict(F.col("coef"), [whole])
    )
    return rows.withColumn("fitted", value).withColumn("residual", F.col(spec.y) - F.col("fitted")).drop("coef")


def accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and MAPE (per cent); months with an actual of 0 are left out of MAPE only."""
    err = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(err, F.col(actual)))) * 100).alias("mape"),
    )
