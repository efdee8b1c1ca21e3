"""Statistics against brute force on small data, and properties that must hold."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.tails import normal_two_sided_p, t_two_sided_p
from panelspark.operators import correlation, count_models, forecast, ordering, regression, reshape, rollup, rows, series
from panelspark.plans import fixture as fx
from panelspark.session import materialise

SF_DIR = "/root/testdata/sf0.001"


def months(n, start=2000):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def frame(spark, columns):
    names = list(columns)
    data = [tuple(row) for row in zip(*columns.values())]
    kinds = {dt.date: "DATE", str: "STRING", int: "BIGINT"}
    schema = ", ".join(f"{n} {kinds.get(type(columns[n][0]), 'DOUBLE')}" for n in names)
    return spark.createDataFrame(
        [tuple(v.item() if isinstance(v, np.generic) else v for v in row) for row in data], schema
    )


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for key in ("a", "b"):
        x = rng.normal(size=(40, 3)) * [1, 100, 0.01] + [5, 1000, 0]
        y = 3 + x @ [2, -0.5, 40] + rng.normal(size=40)
        data += [(key, float(v), *map(float, r)) for v, r in zip(y, x)]
        full = np.column_stack([np.ones(40), x])
        b, sse = np.linalg.lstsq(full, y, rcond=None)[:2]
        cov = np.linalg.inv(full.T @ full) * sse[0] / 36
        want[key] = (b, np.sqrt(np.diag(cov)), sse[0])
    df = spark.createDataFrame(data, "k STRING, y DOUBLE, x1 DOUBLE, x2 DOUBLE, x3 DOUBLE")
    for r in regression.fit_ols(df, ["k"], "y", ["x1", "x2", "x3"]).collect():
        b, se, sse = want[r.k]
        assert np.allclose(r.coef, b, rtol=1e-6) and np.allclose(r.se, se, rtol=1e-6) and math.isclose(r.sse, sse, rel_tol=1e-8)


def test_pooled_fit_equals_fit_on_the_sum(spark):
    rng = np.random.default_rng(2)
    n = 50
    spec = regression.Spec(lags=(0, 1, 2))
    cols = {"month": months(n), **{c: list(rng.normal(size=n)) for c in (spec.y, *spec.xs)}}
    design = regression.lag_design(frame(spark, cols), [], "month", spec)
    both = {(r.lag, r.model): r for r in regression.fit_lagged(design, [], spec).collect()}
    summed = design.withColumn("t", sum((F.col(x) for x in spec.xs), F.lit(0.0)))
    for r in regression.fit_ols(summed, ["lag"], spec.y, ["t"]).collect():
        assert np.allclose(both[(r.lag, "Combined")].coef, r.coef)
    stats = regression.fit_stats(regression.fit_lagged(design, [], spec))
    assert all(0 <= r.r_squared <= 1 for r in stats.collect())
    assert {r.n for r in stats.where("lag = 2").collect()} == {n - 1 - 2}
    shared = regression.common_sample(design, [], "month", spec.lags).groupBy("lag").count().collect()
    assert {r["count"] for r in shared} == {n - 1 - 2}


@pytest.mark.parametrize("t, df", [(12.7, 1), (2.2, 10), (0.0, 5), (-1.71, 104), (2.776, 4), (3.1, 2), (1.0, 1999), (1.0, 2500)])
def test_t_tail(spark, t, df):
    """Against the density integrated numerically between -|t| and |t|."""
    x = np.linspace(0, abs(t), 200_001)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    want = 1 - 2 * np.trapezoid(scale * (1 + x * x / df) ** (-(df + 1) / 2), x)
    got = spark.range(1).select(F.lit(t).alias("t")).select(t_two_sided_p("t", str(df))).first()[0]
    assert math.isclose(got, want, abs_tol=1e-6)


def test_normal_tail(spark):
    for z in (0.0, 0.5, 1.96, 4.0, 8.0, 8.5, 10.0, 30.0):
        got = spark.range(1).select(F.lit(z).alias("z")).select(normal_two_sided_p("z")).first()[0]
        assert math.isclose(got, math.erfc(z / math.sqrt(2)), rel_tol=1e-9)


def test_far_t_tails(spark):
    """Closed forms for 1 and 2 degrees of freedom, the normal for very many, and no step at any size."""

    def p(t, df):
        return spark.range(1).select(F.lit(t).alias("t")).select(t_two_sided_p("t", str(df))).first()[0]

    for t in (0.1, 4.0, 1e4, 1e8):
        assert math.isclose(p(t, 1), 2 / math.pi * math.atan(1 / t), rel_tol=1e-9)
        assert math.isclose(p(t, 2), 2 / (math.sqrt(2 + t * t) * (math.sqrt(2 + t * t) + t)), rel_tol=1e-9)
    assert math.isclose(p(9.0, 10**13), math.erfc(9 / math.sqrt(2)), rel_tol=1e-9)
    assert p(4.0, 1999) > p(4.0, 2000) > p(4.0, 2001) > p(4.0, 2002)


def test_quantiles_and_codes_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros(700), rng.integers(-400, 900, 1400).astype(float) / 4])
    k = np.where(np.arange(2100) % 3 == 0, "a", "b")
    df = frame(spark, {"k": [str(v) for v in k], "x": list(x)})
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    assert np.allclose(ordering.exact_quantiles(df, "x", probs).first().quantiles, np.quantile(x, probs))
    for r in ordering.exact_quantiles(df, "x", probs, ["k"]).collect():
        assert np.allclose(r.quantiles, np.quantile(x[k == r.k], probs))
    codes = {r.x: r.code for r in ordering.dense_codes(df, "x").collect()}
    assert codes == {v: i for i, v in enumerate(sorted(set(x)), 1)}
    by = {(r.k, r.x): r.code for r in ordering.dense_codes(df, "x", ["k"]).collect()}
    assert by == {(g, v): i for g in "ab" for i, v in enumerate(sorted(set(x[k == g])), 1)}


@pytest.mark.parametrize("bucket,ways", [(60, 3), (200, 128), (3, 2)])
def test_no_bucket_is_larger_than_its_bound(spark, monkeypatch, bucket, ways):
    """Values bunched on a few scales, one group with most of the rows, a null group."""
    monkeypatch.setattr(ordering, "BUCKET", bucket)
    monkeypatch.setattr(ordering, "WAYS", ways)
    rng = np.random.default_rng(7)
    n = 4000 if bucket > 3 else 300
    data = [("hot", float(v)) for v in np.unique(np.concatenate([rng.exponential(1e-6, n // 2), rng.normal(size=n // 2) * 1e6]))]
    data += [("cold", float(v)) for v in range(bucket)] + [(None, -float(v)) for v in range(2 * bucket + 1)]
    rows = materialise(spark.createDataFrame(data, "k STRING, x DOUBLE").repartition(6), "values")
    found, several = ordering.bucketed(rows, "x", ["k"])
    assert several and found.count() == len(data)
    per = found.groupBy("k", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    assert max(r.n for r in per) <= bucket
    for k in ("hot", "cold", None):
        own = sorted((r._bucket, r.lo, r.hi) for r in per if r.k == k)
        assert all(a[2] < b[1] for a, b in zip(own, own[1:]))
        assert (len(own) == 1) == (k == "cold")
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.k: r.quantiles for r in ordering.exact_quantiles(rows, "x", probs, ["k"]).collect()}
    values = {k: sorted(x for g, x in data if g == k) for k in ("hot", "cold", None)}
    for k, v in values.items():
        assert np.allclose(got[k], np.quantile(v, probs), rtol=1e-12)
    codes = {(r.k, r.x): r.code for r in ordering.dense_codes(rows, "x", ["k"]).collect()}
    assert codes == {(k, x): i for k, v in values.items() for i, x in enumerate(v, 1)}
    assert ordering.exact_quantiles(rows.limit(0), "x", probs, ["k"]).count() == 0


def test_acf_pacf_ccf_against_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=60).cumsum(), rng.normal(size=60)
    df = frame(spark, {"month": months(60), "value": list(x), "other": list(y)})
    c = x - x.mean()
    rho = [float(c[: 60 - h] @ c[h:]) / float(c @ c) for h in range(18)]
    got = [r.acf for r in series.acf(df, []).orderBy("lag").collect()]
    assert len(got) == 18 and np.allclose(got, rho)
    want = []
    for k in range(1, 18):
        toeplitz = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(toeplitz, rho[1 : k + 1])[-1])
    assert np.allclose([r.pacf for r in series.pacf(df, []).orderBy("lag").collect()], want)
    e = y - y.mean()
    for r in series.ccf(df, [], "value", "other", 3).collect():
        h = r.lag
        pair = sum(c[t + h] * e[t] for t in range(60) if 0 <= t + h < 60)
        assert math.isclose(r.ccf, pair / math.sqrt((c @ c) * (e @ e)), rel_tol=1e-9)


def test_noiseless_autoregression_is_exact(spark):
    y = [10.0]
    for _ in range(59):
        y.append(2 + 0.7 * y[-1])
    y = [v + 3 * (-0.5) ** i for i, v in enumerate(y)]
    a = np.array(y)
    df = frame(spark, {"k": ["s"] * 40, "month": months(40), "value": y[:40]})
    models = forecast.fit_ar(df, ["k"], max_p=2)
    got = [r.forecast for r in forecast.forecast(models, ["k"], 2, 12).orderBy("step").collect()]
    assert np.allclose(got, a[40:52], atol=1e-4)


def test_interval_widths(spark):
    rng = np.random.default_rng(5)
    y = [0.0]
    for e in rng.normal(size=199):
        y.append(0.6 * y[-1] + e)
    df = frame(spark, {"month": months(200), "value": y})
    for d in (0, 1):
        models = forecast.fit_ar(df, [], max_p=3, d=d)
        m = models.first()
        psi = [1.0]
        for j in range(1, 6):
            psi.append(sum(m.phi[i] * psi[j - 1 - i] for i in range(3) if j - 1 - i >= 0))
        weights = np.cumsum(psi) if d else np.array(psi)
        want = 2 * 1.959963984540054 * np.sqrt(m.sigma2 * np.cumsum(weights**2))
        got = [r.upper_95 - r.lower_95 for r in forecast.forecast(models, [], 3, 6, d=d).orderBy("step").collect()]
        assert np.allclose(got, want)


def test_order_choice_against_brute_force(spark):
    rng = np.random.default_rng(6)
    y = [0.0, 0.0]
    for e in rng.normal(size=118):
        y.append(1 + 0.5 * y[-1] - 0.3 * y[-2] + e)
    a, top = np.array(y), 4
    target = a[top:]
    lags = np.column_stack([a[top - j : len(a) - j] for j in range(1, top + 1)])
    best = None
    for p in range(top + 1):
        full = np.column_stack([np.ones(len(target)), lags[:, :p]])
        b = np.linalg.lstsq(full, target, rcond=None)[0]
        sse = float(((target - full @ b) ** 2).sum())
        aic = len(target) * math.log(sse / len(target)) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, p, b, sse)
    m = forecast.fit_ar(frame(spark, {"month": months(120), "value": y}), [], max_p=top).first()
    assert m.p == best[1] and math.isclose(m.aic, best[0], rel_tol=1e-9) and math.isclose(m.intercept, best[2][0], rel_tol=1e-8)
    assert np.allclose(m.phi[: m.p], best[2][1:]) and not any(m.phi[m.p :])


def test_lagged_test_regressor_switch(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=60)
    y = np.concatenate([[0.0], 3 * x[:-1]]) + 0.01 * rng.normal(size=60)
    parts = rows.holdout(frame(spark, {"month": months(60), "y": list(y), "x": list(x)}), [], "month")
    error = {}
    for switch in (True, False):
        paths = forecast.arx_forecast(parts, [], "month", "y", "x", [1], 2, lag_test=switch)
        error[switch] = regression.accuracy(paths, "actual", "forecast").first().rmse
    assert error[True] < 0.1 < 1 < error[False]


def test_unit_root_statistic_against_numpy(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=90).cumsum()
    k, d = 4, np.diff(y)
    t = np.arange(k, len(d))
    full = np.column_stack([np.ones(len(t)), y[t], t + 1, *[d[t - j] for j in range(1, k + 1)]])
    b = np.linalg.lstsq(full, d[t], rcond=None)[0]
    s2 = ((d[t] - full @ b) ** 2).sum() / (len(t) - full.shape[1])
    want = b[1] / math.sqrt(s2 * np.linalg.inv(full.T @ full)[1, 1])
    got = series.adf(frame(spark, {"month": months(90), "value": list(y)}), [], k_max=6).first()
    assert got.k == 4 and math.isclose(got.statistic, want, rel_tol=1e-6)


def test_decomposition_adds_up(spark):
    rng = np.random.default_rng(9)
    y = [5 + 0.1 * i + 3 * math.sin(i / 6 * math.pi) + e for i, e in enumerate(rng.normal(size=48))]
    got = series.decompose(frame(spark, {"month": months(48), "value": y}), []).orderBy("month").collect()
    assert sum(r.trend is None for r in got) == 12
    assert abs(sum({r.month.month: r.season for r in got}.values())) < 1e-9
    assert all(math.isclose(r.value, r.trend + r.season + r.remainder) for r in got if r.trend is not None)


def test_count_model_against_newton(spark):
    rng = np.random.default_rng(10)
    data = []
    for region in ("a", "b", "c"):
        for i, m in enumerate(months(30)):
            xs = [int(v) for v in rng.poisson(3, 4)]
            mu = 500 * math.exp(-6 + 0.1 * xs[0] + 0.01 * i)
            data.append((region, m, float(rng.poisson(mu)), *xs, 500))
    df = spark.createDataFrame(data, "region STRING, month DATE, hum_cases DOUBLE, catt_cases INT, cam_cases INT, goat_cases INT, shp_cases INT, pop INT")
    spec = count_models.CountSpec(lags=(1,))
    design = count_models.count_design(df, spec).toPandas()
    assert len(design) == 3 * 29
    x = np.column_stack([design[c] for c in [*spec.predictors, "time_code"]] + [np.ones(len(design))])
    assert np.allclose(x[:, :4].mean(0), 0, atol=1e-12) and np.allclose(x[:, :4].std(0, ddof=1), 1)
    y, off = design["hum_cases"].to_numpy(), design["log_pop"].to_numpy()
    b = np.zeros(6)
    b[-1] = math.log(y.sum() / np.exp(off).sum())
    for _ in range(30):
        mu = np.exp(off + x @ b)
        info = x.T @ (x * mu[:, None])
        b = b + np.linalg.solve(info, x.T @ (y - mu))
    mu = np.exp(off + x @ b)
    phi = ((y - mu) ** 2 / mu).sum() / (len(y) - 6)
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    names = [*spec.predictors, "time_code", "(Intercept)"]
    for family, scale in (("poisson", 1.0), ("quasipoisson", math.sqrt(phi))):
        got = {r.term: r for r in count_models.fit_count_model(df, spec, family).collect()}
        for i, name in enumerate(names):
            assert math.isclose(got[name].estimate, b[i], rel_tol=1e-5, abs_tol=1e-7)
            assert math.isclose(got[name].std_error, se[i] * scale, rel_tol=1e-4)
    effects = count_models.fit_count_model(df, count_models.CountSpec(lags=(0,), combined=True, region_effects=True))
    assert effects.where(F.col("term").startswith("region_")).count() == 2
    ratios = count_models.rate_ratios(effects).where("term = 'animal_cases'").first()
    assert ratios.conf_low < ratios.rate_ratio < ratios.conf_high


def _count_rows(seed, regions, n, level=0.0):
    rng = np.random.default_rng(seed)
    data = []
    for i, region in enumerate(regions):
        shift = rng.normal() * level
        for t, m in enumerate(months(n - i)):
            xs = [int(v) for v in rng.poisson(3, 4)]
            mu = 800 * math.exp(-6 + 0.1 * xs[0] + 0.01 * t + shift)
            data.append((region, m, float(rng.poisson(mu)), *xs, 800))
    return data


_COUNT_SCHEMA = "region STRING, month DATE, hum_cases DOUBLE, catt_cases INT, cam_cases INT, goat_cases INT, shp_cases INT, pop INT"


def _newton(x, y, off, penalty=0.0):
    b = np.zeros(x.shape[1])
    b[0] = math.log(y.sum() / np.exp(off).sum())
    for _ in range(60):
        mu = np.exp(off + x @ b)
        info = x.T @ (x * mu[:, None]) + np.diag(np.broadcast_to(penalty, len(b)))
        b = b + np.linalg.solve(info, x.T @ (y - mu) - penalty * b)
    return b, np.sqrt(np.diag(np.linalg.inv(info)))


def test_counts_by_region_freeze_apart(spark):
    data = _count_rows(3, ["a", "b", "c", "none"], 40)
    data = [(r, m, 0.0 if r == "none" else y, *rest) for r, m, y, *rest in data]
    df = spark.createDataFrame(data, _COUNT_SCHEMA)
    spec = count_models.CountSpec(lags=(0, 2))
    design = count_models.count_design(df, spec).toPandas()
    got = {(r.region, r.lag, r.term): r for r in count_models.fit_count_model(df, spec, by_region=True).collect()}
    assert len(got) == 4 * 2 * 6
    names = ["(Intercept)", *spec.inputs]
    for region in ("a", "b", "c"):
        for lag in spec.lags:
            own = design[(design["lag"] == lag) & (design["region"] == region)]
            x = np.column_stack([np.ones(len(own)), own[spec.inputs].to_numpy(float)])
            b, se = _newton(x, own["hum_cases"].to_numpy(), own["log_pop"].to_numpy())
            for i, name in enumerate(names):
                r = got[region, lag, name]
                assert r.converged and math.isclose(r.estimate, b[i], abs_tol=1e-7) and math.isclose(r.std_error, se[i], rel_tol=1e-6)
    # no case at all: no finite estimate, and the others don't wait for it
    assert all(got["none", lag, n].estimate is None and not got["none", lag, n].converged for lag in spec.lags for n in names)
    short = count_models.fit_count_model(df, spec, max_iter=2).collect()
    assert len(short) == 12 and not any(r.converged for r in short)


def _region_matrix(design, spec):
    regions = sorted(design["region"].unique())
    return regions, np.column_stack([(design["region"] == r).to_numpy(float) for r in regions])


def test_region_effects_between_their_limits(spark):
    spec = count_models.CountSpec(lags=(0,), combined=True)
    df = spark.createDataFrame(_count_rows(4, list("abcdef"), 30, 0.5), _COUNT_SCHEMA)
    design = count_models.count_design(df, spec).cache()
    rows = design.toPandas()
    y, off = rows["hum_cases"].to_numpy(), rows["log_pop"].to_numpy()
    x = np.column_stack([np.ones(len(rows)), rows[spec.inputs].to_numpy(float)])
    regions, dummies = _region_matrix(rows, spec)

    def fit(variance, tolerance=1e-10):
        return {r.region: r for r in count_models.fit_region_effects(design, spec, variance, tolerance=tolerance).collect()}

    # no variance is the pooled fit, unlimited variance the fit with dummies
    pooled, _ = _newton(x, y, off)
    none = fit(0.0)
    assert np.allclose(none["a"].coef, pooled, atol=1e-8) and all(r.effect == 0 and r.converged for r in none.values())
    full, se = _newton(np.column_stack([dummies, x[:, 1:]]), y, off)
    free = fit(float("inf"))
    assert np.allclose([free[r].effect for r in regions], full[:6], atol=1e-7)
    assert np.allclose(free["a"].coef[1:], full[6:], atol=1e-8) and np.allclose(free["a"].se[1:], se[6:], rtol=1e-6)
    # in between: ridge on the levels
    middle = fit(0.04)
    want, _ = _newton(np.column_stack([x, dummies]), y, off, np.array([0.0] * 3 + [25.0] * 6))
    assert np.allclose(middle["a"].coef, want[:3], atol=1e-7)
    assert np.allclose([middle[r].effect for r in regions], want[3:], atol=1e-7)
    wide = fit(1e4, 1e-7)
    assert np.allclose([wide[r].effect + wide[r].coef[0] for r in regions], full[:6], atol=1e-4)
    # an estimated variance is its own mean square, and effects lie nearer to 0 than the dummies
    found = list(count_models.fit_region_effects(design, spec, tolerance=1e-7).collect())
    assert all(r.converged for r in found)
    again = np.mean([r.effect**2 + r.effect_se**2 for r in found])
    assert math.isclose(found[0].g00, again, rel_tol=1e-4) and 0.01 < found[0].g00 < 2
    # terms against the region with the most rows
    terms = {r.term: r for r in count_models.fit_count_model(df, count_models.CountSpec(lags=(0,), combined=True, region_effects=True)).collect()}
    against, errors = _newton(np.column_stack([np.ones(len(rows)), dummies[:, 1:], x[:, 1:]]), y, off)
    names = ["(Intercept)", *[f"region_{r}" for r in regions[1:]], *spec.inputs]
    assert set(terms) == set(names)
    for i, name in enumerate(names):
        assert math.isclose(terms[name].estimate, against[i], abs_tol=1e-7) and math.isclose(terms[name].std_error, errors[i], rel_tol=1e-6)


def test_levels_and_slopes_of_regions(spark):
    spec = count_models.CountSpec(lags=(1,), combined=True)
    rng = np.random.default_rng(6)
    data = []
    for region in "abcdefgh":
        shift, tilt = rng.normal() * 0.4, rng.normal() * 0.02
        for t, m in enumerate(months(40)):
            xs = [int(v) for v in rng.poisson(3, 4)]
            data.append((region, m, float(rng.poisson(600 * math.exp(-4 + 0.05 * xs[0] + shift + tilt * t))), *xs, 600))
    design = count_models.count_design(spark.createDataFrame(data, _COUNT_SCHEMA), spec).cache()
    found = count_models.fit_region_effects(design, spec, slope=True, max_iter=25, tolerance=1e-3).collect()
    g = np.array([[found[0].g00, found[0].g01], [found[0].g01, found[0].g11]])
    assert np.linalg.eigvalsh(g).min() > 0 and 0.005 < math.sqrt(g[1, 1]) < 0.08
    # the coefficients are those of the penalised fit with this covariance
    rows = design.toPandas()
    regions, dummies = _region_matrix(rows, spec)
    x = np.column_stack([np.ones(len(rows)), rows[spec.inputs].to_numpy(float)])
    z = np.column_stack([dummies, dummies * rows["time_code"].to_numpy()[:, None]])
    full = np.column_stack([x, z])
    penalty = np.zeros((full.shape[1],) * 2)
    penalty[3:, 3:] = np.kron(np.linalg.inv(g), np.eye(len(regions)))
    b = np.zeros(full.shape[1])
    y, off = rows["hum_cases"].to_numpy(), rows["log_pop"].to_numpy()
    b[0] = math.log(y.sum() / np.exp(off).sum())
    for _ in range(60):
        mu = np.exp(off + full @ b)
        b = b + np.linalg.solve(full.T @ (full * mu[:, None]) + penalty, full.T @ (y - mu) - penalty @ b)
    by = {r.region: r for r in found}
    assert np.allclose(found[0].coef, b[:3], atol=5e-3)
    assert np.allclose([by[r].effect for r in regions], b[3:11], atol=1e-2)
    assert np.allclose([by[r].time_effect for r in regions], b[11:], atol=1e-3)


def test_strict_correlation(spark):
    df = frame(spark, {"month": months(5), "a": [1.0, 2.0, 4.0, 3.0, 5.0], "b": [2.0, 1.0, 3.0, 5.0, 4.0]})
    broken = df.withColumn("b", F.when(F.col("b") > 1, F.col("b")))
    strict = {(r.var_1, r.var_2): r.r for r in correlation.corr_matrix(broken, ["a", "b"]).collect()}
    assert strict[("a", "b")] is None and strict[("a", "a")] == 1.0
    loose = {(r.var_1, r.var_2): r.r for r in correlation.corr_matrix(broken, ["a", "b"], strict=False).collect()}
    assert math.isclose(loose[("b", "a")], np.corrcoef([1, 4, 3, 5], [2, 3, 5, 4])[0, 1])


def test_rollup_totals_agree(spark):
    panel = fx.base_panel(spark, SF_DIR)
    rolled = rollup.rollup_counts(panel).groupBy("grain").agg(F.sum("hum_cases").alias("n")).collect()
    total = fx.table(spark, SF_DIR, "orders").where("o_orderpriority = '1-URGENT'").count()
    assert {r.grain for r in rolled} == set(rollup.GRAINS) and {r.n for r in rolled} == {total}


def test_unpivot_then_pivot_is_identity(spark):
    panel = fx.base_panel(spark, SF_DIR)
    keys = ["region", "year", "month", "diagnosis"]
    long = reshape.unpivot(panel, keys, rollup.CASES, "variable", "value")
    back = reshape.pivot(long, keys, "variable", {c: c for c in rollup.CASES}, "value")
    assert back.select(*panel.columns).exceptAll(panel).count() == 0 == panel.exceptAll(back.select(*panel.columns)).count()


def test_standardised_columns(spark):
    monthly = fx.regional_months(spark, SF_DIR).select("region", F.col("hum_cases").cast("double").alias("v"))
    z = rows.standardise(monthly, ["v"]).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    assert abs(z.m) < 1e-12 and math.isclose(z.s, 1.0)


def test_local_decomposition(spark):
    n = 96
    season = np.sin(np.arange(n) * 2 * np.pi / 12) * 5
    y = 3 + 0.5 * np.arange(n) + season
    spiked = y.copy()
    spiked[40] += 200
    data = [("plain", m, float(v)) for m, v in zip(months(n), y)] + [("spiked", m, float(v)) for m, v in zip(months(n), spiked)]
    data += [("short", m, float(v)) for m, v in zip(months(23), y)] + [(None, m, 4.0) for m in months(30)] + [("plain", dt.date(1990, 1, 1), None)]
    df = spark.createDataFrame(data, "k STRING, month DATE, value DOUBLE").repartition(3)
    for robust in (0, 4):
        got = {}
        for r in series.decompose_local(df, ["k"], inner=20, robust=robust).orderBy("month").collect():
            got.setdefault(r.k, []).append(r)
        assert {k: len(v) for k, v in got.items()} == {"plain": n, "spiked": n, "short": 23, None: 30}
        # a line and a season that repeats are found as they are
        assert np.allclose([r.season for r in got["plain"]], season, atol=1e-2)
        assert np.allclose([r.trend for r in got["plain"]], 3 + 0.5 * np.arange(n), atol=1e-2)
        assert all(r.trend is None and r.season is None and r.remainder is None and r.value is not None for r in got["short"])
        assert np.allclose([r.trend for r in got[None]], 4) and np.allclose([r.season for r in got[None]], 0)
        off = np.abs(np.array([r.trend + r.season for r in got["spiked"]]) - y).max()
        assert (off < 0.05) == (robust > 0)
    twice = spark.createDataFrame([("a", months(1)[0], 1.0)] * 2, "k STRING, month DATE, value DOUBLE")
    with pytest.raises(Exception, match="two rows for one month"):
        series.decompose_local(twice, ["k"]).collect()
    assert series.decompose_local(df.limit(0), ["k"]).count() == 0


def test_regression_with_autoregressive_errors(spark):
    """Against the likelihood of the whole covariance matrix, and its neighbours."""
    rng = np.random.default_rng(12)

    def deviance(y, x, c, beta, phi):
        n, p = len(y), len(phi)
        psi = np.zeros(4000)
        psi[0] = 1
        for t in range(1, len(psi)):
            k = min(t, p)
            psi[t] = phi[:k] @ psi[t - 1 :: -1][:k] if k else 0.0
        cov = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])
        cov = cov[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
        u = y - c - beta * x
        return n * math.log(u @ np.linalg.solve(cov, u) / n) + np.linalg.slogdet(cov)[1]

    data, made = [], {}
    for key, phi in (("a", [0.8]), ("b", [0.5, 0.3]), ("c", []), (None, [0.6])):
        n = 60
        x, u = rng.normal(size=n).cumsum() + 50, np.zeros(n + 50)
        for t in range(2, n + 50):
            u[t] = sum(f * u[t - 1 - j] for j, f in enumerate(phi)) + rng.normal()
        y = 10 + 0.7 * x + u[50:]
        made[key] = (y, x)
        data += [(key, m, float(a), float(b)) for m, a, b in zip(months(n), y, x)]
    flat = [("flat", m, float(v), 2.0) for m, v in zip(months(30), rng.normal(size=30))]
    few = [("few", m, 3.0 + i, 1.0 * i) for i, m in enumerate(months(2))]
    gap = [("a", dt.date(1999, 12, 1), None, 1.0)]
    df = spark.createDataFrame(data + flat + few + gap, "k STRING, month DATE, value DOUBLE, x DOUBLE").repartition(4)
    models = {r.k: r for r in forecast.fit_ar_errors(df, ["k"], xreg="x", max_p=3).collect()}
    assert set(models) == {"a", "b", "c", None, "flat", "few"}
    for key, (y, x) in made.items():
        m = models[key]
        phi = np.array(m.phi[: m.p])
        c = m.intercept / (1 - phi.sum())
        assert m.converged and m.n == 60 and all(f == 0 for f in m.phi[m.p :])
        best = deviance(y, x, c, m.beta, phi)
        assert math.isclose(best + 2 * (m.p + 3), m.aic, rel_tol=1e-9)
        for step in (1e-3, -1e-3):
            assert deviance(y, x, c + step, m.beta, phi) > best and deviance(y, x, c, m.beta + step, phi) > best
            for j in range(m.p):
                assert deviance(y, x, c, m.beta, phi + step * np.eye(m.p)[j]) > best
        assert np.allclose(m.recent, (y - m.beta * x)[::-1][:3])
    assert abs(models["a"].beta - 0.7) < 0.2
    assert models["flat"].beta == 0 and models["flat"].converged
    assert models["few"].aic is None and math.isclose(models["few"].intercept, 3.5) and models["few"].sigma2 is None
    assert not any(r.converged for r in forecast.fit_ar_errors(df.where("k = 'b'"), ["k"], xreg="x", max_p=2, steps=1).collect())
    # differences: the regressor is differenced as well, and forecasts go on from the last level
    one = forecast.fit_ar_errors(df.where("k = 'c'"), ["k"], xreg="x", max_p=0, d=1).first()
    y, x = made["c"]
    dy, dx = np.diff(y), np.diff(x)
    assert math.isclose(one.beta, np.cov(dy, dx)[0, 1] / np.var(dx, ddof=1), rel_tol=1e-9) and one.last_x == x[-1]
    ahead = spark.createDataFrame([("c", dt.date(2010, 1, 1), 60.0), ("c", dt.date(2010, 2, 1), 61.0)], "k STRING, month DATE, x DOUBLE")
    model = forecast.fit_ar_errors(df.where("k = 'c'"), ["k"], xreg="x", max_p=1, d=1)
    got = forecast.forecast(model, ["k"], 1, future=ahead, xreg="x", d=1).orderBy("month").collect()
    m = model.first()
    v = m.recent[0]
    want, level, before = [], y[-1], x[-1]
    for value in (60.0, 61.0):
        v = m.intercept + m.phi[0] * v
        level, before = level + v + m.beta * (value - before), value
        want.append(level)
    assert np.allclose([r.forecast for r in got], want)


def test_digamma_and_trigamma(spark):
    from panelspark.functions.tails import digamma, trigamma

    got = spark.createDataFrame([(0.01,), (0.5,), (1.0,), (3.7,), (1e5,)], "z DOUBLE").selectExpr("z", f"{digamma('z')} AS d", f"{trigamma('z')} AS t").collect()
    euler = 0.5772156649015329
    want = {0.5: (-euler - 2 * math.log(2), math.pi**2 / 2), 1.0: (-euler, math.pi**2 / 6)}
    for r in got:
        h = 1e-4 * r.z
        assert math.isclose(r.d, (math.lgamma(r.z + h) - math.lgamma(r.z - h)) / (2 * h), rel_tol=1e-5, abs_tol=1e-6)
        if r.z in want:
            assert np.allclose((r.d, r.t), want[r.z], rtol=1e-12)


def test_linear_variance_counts_at_their_maximum(spark):
    rng = np.random.default_rng(21)
    data = []
    for region in ("a", "b", "c", "d"):
        for t, m in enumerate(months(60)):
            xs = [int(v) for v in rng.poisson(3, 4)]
            mu = 800 * math.exp(-5.5 + 0.1 * xs[0] + 0.01 * t)
            y = rng.negative_binomial(mu / 3, 0.25) if region != "d" else rng.binomial(20, min(mu / 20, 0.9))
            data.append((region, m, float(y), *xs, 800))
    df = spark.createDataFrame(data, _COUNT_SCHEMA)
    spec = count_models.CountSpec(lags=(0,), combined=True)
    design = count_models.count_design(df, spec).cache()
    found = {r.region: r for r in count_models.fit_linear_variance(design, ["region", "lag"], spec).collect()}
    rows = design.toPandas()
    lgamma = np.vectorize(math.lgamma)

    def likelihood(own, b, excess):
        x = np.column_stack([np.ones(len(own)), own[spec.inputs].to_numpy(float)])
        a, y = np.exp(own["log_pop"].to_numpy() + x @ b) / excess, own["hum_cases"].to_numpy()
        return (lgamma(y + a) - lgamma(a) - a * math.log1p(excess) + y * math.log(excess / (1 + excess))).sum()

    for region in "abc":
        r, own = found[region], rows[rows["region"] == region]
        b, excess = np.array(r.coef), r.dispersion - 1
        best = likelihood(own, b, excess)
        assert r.converged and 1 < excess < 8
        for i in range(3):
            for step in (1e-4, -1e-4):
                assert likelihood(own, b + step * np.eye(3)[i], excess) < best
        for factor in np.linspace(0.5, 2, 31):
            assert likelihood(own, b, excess * factor) <= best + 1e-9
    # counts that vary less than Poisson counts: the Poisson fit
    own = rows[rows["region"] == "d"]
    b, se = _newton(np.column_stack([np.ones(len(own)), own[spec.inputs].to_numpy(float)]), own["hum_cases"].to_numpy(), own["log_pop"].to_numpy())
    assert found["d"].converged and math.isclose(found["d"].dispersion, 1 + count_models.LEAST_EXCESS)
    assert np.allclose(found["d"].coef, b, atol=1e-4) and np.allclose(found["d"].se, se, rtol=1e-3)


def _residuals(y, c, phi, theta, start):
    e = np.zeros(len(y))
    for t in range(start, len(y)):
        ma = sum(v * (e[t - 1 - j] if t - 1 - j >= start else 0.0) for j, v in enumerate(theta))
        e[t] = y[t] - c - sum(f * y[t - 1 - j] for j, f in enumerate(phi)) - ma
    return e[start:]


def test_moving_average_terms(spark):
    rng = np.random.default_rng(31)
    series_, data = {}, []
    for key, phi, theta, n in (("ar", [0.6], [], 150), ("ma", [], [0.7, 0.2], 160), (None, [0.5], [0.4], 140)):
        e = rng.normal(size=n + 50)
        y = np.zeros(n + 50)
        for t in range(2, n + 50):
            y[t] = sum(f * y[t - 1 - j] for j, f in enumerate(phi)) + e[t] + sum(v * e[t - 1 - j] for j, v in enumerate(theta))
        series_[key] = y[50:] * 30 + 200
        data += [(key, m, float(v)) for m, v in zip(months(n), series_[key])]
    data += [("flat", m, 5.0) for m in months(20)] + [("few", m, float(i)) for i, m in enumerate(months(3))] + [("ar", dt.date(1990, 1, 1), None)]
    df = spark.createDataFrame(data, "k STRING, month DATE, value DOUBLE").repartition(3)
    models = {r.k: r for r in forecast.fit_arma(df, ["k"], max_p=2, max_q=2).collect()}
    assert set(models) == {"ar", "ma", None, "flat", "few"}
    for key, y in series_.items():
        m = models[key]
        phi, theta = np.array(m.phi[: m.p]), np.array(m.theta[: m.q])
        sse = lambda c, f, v: (_residuals(y, c, f, v, 2) ** 2).sum()
        best, count = sse(m.intercept, phi, theta), len(y) - 2
        assert m.converged and m.n == len(y)
        assert math.isclose(m.sigma2, best / (count - m.p - m.q - 1), rel_tol=1e-9)
        assert math.isclose(m.aic, count * math.log(best / count) + 2 * (m.p + m.q + 2), rel_tol=1e-9)
        for step in (1e-4, -1e-4):
            assert sse(m.intercept * (1 + step), phi, theta) > best
            assert all(sse(m.intercept, phi + step * np.eye(m.p)[j], theta) > best for j in range(m.p))
            assert all(sse(m.intercept, phi, theta + step * np.eye(m.q)[j]) > best for j in range(m.q))
        assert np.allclose(m.shocks[: m.q], _residuals(y, m.intercept, phi, theta, 2)[::-1][: m.q])
    assert models["ma"].q > 0 and models["few"].aic is None and models["few"].intercept == 1.0 and models["flat"].intercept == 5.0
    paths = forecast.forecast(forecast.fit_arma(df, ["k"], max_p=2, max_q=2), ["k"], 2, 6, max_q=2).orderBy("month").collect()
    for key, y in series_.items():
        m = models[key]
        recent, shocks = list(m.recent), list(m.shocks)
        psi = [1.0]
        for i in range(1, 6):
            psi.append(sum(m.phi[j] * psi[i - 1 - j] for j in range(2) if i - 1 - j >= 0) + (m.theta[i - 1] if i <= 2 else 0.0))
        own = [r for r in paths if r.k == key]
        assert len(own) == 6
        for i, r in enumerate(own):
            v = m.intercept + sum(m.phi[j] * recent[j] + m.theta[j] * shocks[j] for j in range(2))
            recent, shocks = [v, recent[0]], [0.0, shocks[0]]
            width = math.sqrt(m.sigma2 * sum(p * p for p in psi[: i + 1]))
            assert math.isclose(r.forecast, v) and math.isclose(r.upper_95 - r.forecast, forecast.Z_95 * width)
    # a model on the border of the invertible ones: over-differenced noise
    noise = np.diff(rng.normal(size=120))
    edge = forecast.fit_arma(frame(spark, {"month": months(119), "value": list(noise)}), [], max_p=0, max_q=1).first()
    assert edge.converged and -0.98 - 1e-9 <= edge.theta[0] < -0.8
    with pytest.raises(Exception, match="two rows for one month"):
        forecast.fit_arma(frame(spark, {"month": months(1) * 2, "value": [1.0, 2.0]}), []).collect()
    assert forecast.fit_arma(df.limit(0), ["k"]).count() == 0
