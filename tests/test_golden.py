"""Published figures of the national panel.

The yearly totals below are small enough to state. The monthly series is not part
of this repository: name a CSV of it in PANELSPARK_MONTHLY_CSV (columns date and
the five incidence columns) to check the regressions as well.
"""

import math
import os

import pytest
from pyspark.sql import functions as F

from panelspark.operators import correlation, regression, rollup, rows
from panelspark.plans import analyses
from panelspark.plans.panels import growth_rates

# FIXED VALUES: cases per year (human, cattle, camel, goat, sheep) and human population
YEARLY = [
    (2014, 99712.0, 3, 0, 0, 0, 43496899),
    (2015, 330522.0, 26, 1, 31, 1, 44279007),
    (2016, 539482.0, 0, 0, 8, 0, 45076470),
    (2017, 518070.0, 2, 0, 10, 0, 45889619),
    (2018, 658298.0, 31, 0, 25, 0, 46718782),
    (2019, 702247.3, 102, 0, 58, 17, 47564296),
    (2020, 652284.0, 82, 14, 58, 18, 48821000),
    (2021, 647593.0, 96, 8, 177, 27, 49719000),
    (2022, 540579.0, 85, 9, 289, 36, 50621000),
]
ANIMAL_POPS = {"catt_pop": 15774818, "goat_pop": 28011800, "sheep_pop": 19307445, "cam_pop": 4640085}
# FIXED VALUES: published mean, minimum, median, maximum, deviation of the yearly incidence
DESCRIBED = {
    "hum": (10992.68, 2292.39, 11968.15, 14764.17, 3918.56),
    "catt": (3.01, 0, 1.97, 6.47, 2.74),
    "cam": (0.77, 0, 0, 3.02, 1.15),
    "goat": (2.6, 0, 1.11, 10.32, 3.47),
    "shp": (0.57, 0, 0.05, 1.86, 0.72),
}
# FIXED VALUES: published regression figures by lag 0 to 6
RMSE = {
    "Individual": [119.814, 119.849, 123.068, 123.804, 122.762, 124.702, 122.876],
    "Combined": [123.150, 122.160, 124.185, 123.963, 125.177, 126.120, 126.047],
}
R2_INDIVIDUAL = [0.0555, 0.0638, 0.0218, 0.0191, 0.0448, 0.0238, 0.0613]
AIC_COMBINED = [1036.07, 1024.73, 1018.57, 1008.56, 1000.92, 992.80, 983.00]
# FIXED VALUES: correlation of human with cattle, camel, goat, sheep at lags 0, 1, 2
CORRELATION = [
    (0.2252, 0.0601, 0.1153, 0.0949),
    (0.1610, 0.0579, 0.1105, 0.1341),
    (0.2165, 0.0735, 0.1292, 0.2045),
]
# FIXED VALUES: three regions' populations 2020 to 2025 and their published mean growth
GROWTH = {
    "Baringo": ([687000, 702000, 718000, 733000, 749000, 764000], 2.15),
    "Bomet": ([902000, 914000, 927000, 940000, 953000, 965000], 1.36),
    "Bungoma": ([1700000, 1729000, 1758000, 1787000, 1816000, 1845000], 1.65),
}
# FIXED VALUES: published error (RMSE) of the forecast without a regressor, and with the lagged one at lag 0 to 6
FORECAST_RMSE = 123.440
FORECAST_RMSE_BY_LAG = [121.776, 127.632, 124.753, 121.684, 122.843, 131.292, 118.310]


def test_described_incidence(spark):
    cols = "year INT, hum_cases DOUBLE, catt_cases INT, cam_cases INT, goat_cases INT, shp_cases INT, pop INT"
    yearly = spark.createDataFrame(YEARLY, cols).withColumns({k: F.lit(v) for k, v in ANIMAL_POPS.items()})
    rated = rows.rate_columns(yearly, rollup.RATE_PAIRS)
    got = {r.variable: r for r in rollup.incidence_summary(rated).collect()}
    for name, want in DESCRIBED.items():
        r = got[name]
        assert all(math.isclose(a, b, abs_tol=0.0051) for a, b in zip((r.mean, r.min, r.median, r.max, r.sd), want))


def test_growth(spark):
    data = [(k, 2020 + i, p) for k, (pops, _) in GROWTH.items() for i, p in enumerate(pops)]
    got = growth_rates(spark.createDataFrame(data, "region STRING, year INT, pop BIGINT"))
    assert {r.region: r.growth_rate for r in got.collect()} == {k: g for k, (_, g) in GROWTH.items()}


MONTHLY = os.environ.get("PANELSPARK_MONTHLY_CSV", "")


@pytest.fixture(scope="module")
def monthly(spark):
    if not os.path.exists(MONTHLY):
        pytest.skip("no monthly series given")
    raw = spark.read.option("header", True).csv(MONTHLY)
    return raw.select(F.col("date").cast("date").alias("month"), *[F.col(c).cast("double").alias(c) for c in rollup.RATE_PAIRS])


def test_regressions(monthly):
    spec = regression.Spec()
    design = regression.lag_design(monthly, [], "month", spec)
    models = regression.fit_lagged(design, [], spec)
    for r in regression.accuracy(regression.fitted(design, models, [], spec), spec.y, "fitted", ["lag", "model"]).collect():
        assert math.isclose(r.rmse, RMSE[r.model][r.lag], abs_tol=0.0006)
    for r in regression.fit_stats(models).collect():
        assert r.n == 107 - r.lag
        if r.model == "Individual":
            assert math.isclose(r.r_squared, R2_INDIVIDUAL[r.lag], abs_tol=0.00006)
        else:
            assert math.isclose(r.aic, AIC_COMBINED[r.lag], abs_tol=0.006)


def test_correlations(monthly):
    names = ["catt_incidence", "cam_incidence", "goat_incidence", "shp_incidence"]
    matrix = correlation.lagged_corr(monthly, "month", "hum_incidence", names, 2)
    got = {(r.lag, r.var_2): r.r for r in matrix.where("var_1 = 'hum_incidence'").collect()}
    for lag, want in enumerate(CORRELATION):
        assert all(math.isclose(got[(lag, n)], w, abs_tol=0.00006) for n, w in zip(names, want))


def test_forecasts(monthly):
    """Regression with autoregressive errors comes out no worse than the published models, within 5 %."""
    made = analyses.forecasts(monthly)
    assert made["plain"].count() == 22
    plain = regression.accuracy(made["plain"], "actual", "forecast").first().rmse
    assert plain < 1.05 * FORECAST_RMSE
    by_lag = {r.lag: r.rmse for r in made["by_lag"].collect()}
    assert all(by_lag[lag] < 1.05 * want for lag, want in enumerate(FORECAST_RMSE_BY_LAG)), by_lag
    print("RMSE", plain, by_lag)
