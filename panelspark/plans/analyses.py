"""The analyses on the eight panels, each a set of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.functions import vocab as V
from panelspark.operators import classify, correlation, count_models, forecast, regression, rollup, rows, series
from panelspark.session import materialise

DIAGNOSIS_COLUMNS = {V.CLINICAL: "clinical", V.LAB: "lab", V.POST_MORTEM: "post_mortem"}
RATES = list(rollup.RATE_PAIRS)


def descriptives(panels: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """National and regional description of cases and incidence, plain and as published."""
    national = rollup.summary_table(panels["kenya_yah"], panels["kenya_ah"], DIAGNOSIS_COLUMNS)
    regional = rollup.summary_table(panels["yah"], panels["ah"], DIAGNOSIS_COLUMNS, ["region"])
    return {
        "national": national,
        "regional": regional,
        "national_display": rollup.present_summary(national, DIAGNOSIS_COLUMNS),
        "regional_display": rollup.present_summary(regional, DIAGNOSIS_COLUMNS, ["region"]),
    }


def pictures(panels: dict[str, DataFrame], region_names: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the maps and the line charts."""
    return {
        "maps": classify.map_table(
            panels["yah"], region_names, C.recode(F.col("region"), V.MAP_REGION_MAP)
        ),
        "lines": classify.smoothed_long(panels["kenya_ah2"]),
    }


def correlations(panels: dict[str, DataFrame], max_lag: int = 6) -> dict[str, DataFrame]:
    matrix = correlation.lagged_corr(panels["kenya_ah2"], "month", RATES[0], RATES[1:], max_lag)
    return {"matrix": matrix, "average": correlation.avg_abs_corr(matrix, RATES[0])}


def regressions(panels: dict[str, DataFrame], spec: regression.Spec = regression.Spec()) -> dict[str, DataFrame]:
    """National and regional lagged regressions of both specifications."""
    design = regression.lag_design(panels["kenya_ah2"], [], "month", spec)
    models = regression.fit_lagged(design, [], spec)
    coefs = regression.display_terms(regression.coef_table(models, ["lag", "model"]))
    regional = regression.lagged_ols(panels["ah2"], "month", spec, ["region"])
    return {
        "coefficients": coefs,
        "forest": coefs.where(F.col("term") != "(Intercept)"),
        "metrics": regression.accuracy(
            regression.fitted(design, models, [], spec), spec.y, "fitted", ["lag", "model"]
        ),
        "ranked": regression.rank_models(regression.fit_stats(models).select("lag", "model", "aic", "r_squared", "adj_r_squared"), ["model"]),
        "regional": regression.display_terms(regression.coef_table(regional, ["region", "lag", "model"])),
    }


def count_regressions(
    panels: dict[str, DataFrame], lags: Sequence[int] = tuple(range(7)), region_iterations: int = 30
) -> dict[str, DataFrame]:
    """Rate ratios of the pooled model and of the model by species, the latter with scaled errors and by likelihood, and the regions' levels and time slopes."""
    pooled = count_models.CountSpec(combined=True, lags=tuple(lags))
    single = count_models.CountSpec(lags=tuple(lags))
    design = materialise(count_models.count_design(panels["ah2"], pooled), "count-design")
    return {
        "by_species_linear": count_models.rate_ratios(count_models.fit_count_model(panels["ah2"], single, "linear")),
        "regions": count_models.fit_region_effects(design, pooled, slope=True, max_iter=region_iterations, tolerance=1e-3),
        "pooled": count_models.rate_ratios(count_models.fit_count_model(panels["ah2"], pooled)),
        "by_species": count_models.rate_ratios(count_models.fit_count_model(panels["ah2"], single, "quasipoisson")),
    }


def forecasts(
    monthly: DataFrame, history_end: str = "2022-12-01", max_p: int = 5, lags: Sequence[int] = tuple(range(7))
) -> dict[str, DataFrame]:
    """Exploration, hold-out forecasts without and with the animal regressor, and a forecast of the later months."""
    built = series.series_build(monthly, [])
    past, future = rows.date_cutoff(built, "month", history_end), rows.date_cutoff(built, "month", history_end, after=True)
    parts = rows.holdout(past, [], "month")
    plain = forecast.ar_forecast(parts, [], "month", "hum_incidence", max_p, exact=True)
    with_x = forecast.arx_forecast(parts, [], "month", "hum_incidence", "animal_incidence", lags, max_p)
    train = parts.where(F.col("part") == "train")
    full = forecast.fit_ar_errors(past, [], y="hum_incidence", max_p=max_p)
    fitted = forecast.fitted_values(past, full, [], max_p, y="hum_incidence")
    return {
        "decomposed": series.decompose_local(built, [], value="hum_incidence"),
        "unit_root": series.adf(built, [], value="hum_incidence"),
        "acf": series.acf(train, [], value="hum_incidence"),
        "pacf": series.pacf(train, [], value="hum_incidence"),
        "ccf": series.ccf(built, [], "hum_incidence", "animal_incidence"),
        "plain": plain,
        "with_regressor": with_x,
        "by_lag": regression.accuracy(with_x, "actual", "forecast", ["lag"]),
        "comparison": forecast.model_comparison(plain, with_x),
        "full_fitted": fitted,
        "full_forecast": forecast.forecast(full, [], max_p, future=future.select("month")),
        "residual_pairs": forecast.residual_pairs(fitted, [], "month"),
        "residual_histogram": forecast.residual_histogram(fitted.where(F.col("residual").isNotNull()), []),
        "residual_acf": series.acf(fitted, [], value="residual"),
    }
