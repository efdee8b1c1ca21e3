"""Queries of correlations, regressions and count models (I*, O2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import correlation, count_models, regression, rollup
from panelspark.plans import fixture as fx
from panelspark.plans.oracle import SERIES, ols_sql, r, t_p_value, with_sql
from panelspark.plans.registry import query, rounded
from panelspark.session import materialise

INC = [f"{s}_incidence" for s in SERIES]
# camel populations are 0 in some regions, so regional fits meet constant series
SPEC = regression.Spec()
XS = list(SPEC.xs)
KEY = ["region"]


def _corr_sql(source: str, by: list[str]) -> str:
    parts = []
    keys = "".join(f"{k}, " for k in by)
    for a in INC:
        for b in INC:
            guard = f"count({a}) = count(*) AND count({b}) = count(*)"
            value = (
                f"CASE WHEN {guard} AND stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END"
            )
            parts.append(
                f"SELECT {keys}'{a}' AS var_1, '{b}' AS var_2, {r(value, 6, 'r')} FROM {source}"
                + (f" GROUP BY {', '.join(by)}" if by else "")
            )
    return " UNION ALL ".join(parts)


def _lag_blocks(source: str, cols: list[str], key: list[str], keep: str, diff: bool, max_lag: int = 6) -> list[tuple[str, str]]:
    """Rows by row number; predictors by self-join on it, ``lag`` rows earlier."""
    part = f"PARTITION BY {', '.join(key)} " if key else ""
    keys = "".join(f"{k}, " for k in key)
    blocks = []
    if diff:
        filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [keep, *cols])
        blocks.append(("src", f"SELECT {keys}month, {filled} FROM {source}"))
        d = ", ".join(f"{c} - lag({c}) OVER (w) AS {c}" for c in [keep, *cols])
        blocks.append(
            (
                "steps",
                f"SELECT *, row_number() OVER ({part}ORDER BY month) AS k FROM (SELECT {keys}month, {d} FROM src WINDOW w AS ({part}ORDER BY month)) WHERE {keep} IS NOT NULL",
            )
        )
    else:
        blocks.append(
            (
                "steps",
                f"SELECT {keys}month, {keep}, {', '.join(cols)}, row_number() OVER ({part}ORDER BY month) AS k FROM {source}",
            )
        )
    on = " AND ".join([f"a.{k} = b.{k}" for k in key] + ["b.k = a.k - l.lag"])
    blocks.append(
        (
            "design",
            f"SELECT {''.join(f'a.{k}, ' for k in key)}a.month, l.lag::INT AS lag, a.{keep}, {', '.join(f'b.{c}' for c in cols)}, "
            f"{' + '.join(f'b.{c}' for c in cols)} AS animal FROM steps a CROSS JOIN range(0, {max_lag + 1}) l(lag) LEFT JOIN steps b ON {on}",
        )
    )
    return blocks


def _complete(cols: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


# ---------------------------------------------------------------- correlations


@query("i1_corr_matrix", with_sql(_corr_sql("regional_months", KEY)))
def i1(spark, sf):
    return rounded(correlation.corr_matrix(fx.regional_months(spark, sf), INC, KEY))


_LAGGED_CORR = _lag_blocks("national_months", INC[1:], [], INC[0], diff=False)
_USED = ("used", f"SELECT * FROM design WHERE lag = 0 OR ({_complete(INC)})")


@query("i2_lagged_corr", with_sql(_corr_sql("used", ["lag"]), [*_LAGGED_CORR, _USED]))
def i2(spark, sf):
    return rounded(correlation.lagged_corr(fx.national_months(spark, sf), "month", INC[0], INC[1:]))


@query(
    "i3_avg_abs_corr",
    with_sql(
        "SELECT region, lag, "
        + r("(" + " + ".join(f"abs(corr(hum_cases, {s}_cases))" for s in SERIES[1:]) + ") / 4", 6, "avg_abs_cor")
        + f" FROM design WHERE lag = 0 OR ({_complete([f'{s}_cases' for s in SERIES])}) GROUP BY region, lag",
        _lag_blocks("regional_counts", [f"{s}_cases" for s in SERIES[1:]], KEY, "hum_cases", diff=False),
    ),
)
def i3(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], rollup.CASES)
    matrix = correlation.lagged_corr(monthly, "month", "hum_cases", [f"{s}_cases" for s in SERIES[1:]], key=KEY)
    return rounded(correlation.avg_abs_corr(matrix, "hum_cases", KEY))


# ---------------------------------------------------------------- lagged least squares


def _models_blocks(source: str, key: list[str]) -> list[tuple[str, str]]:
    by = [*key, "lag"]
    return [
        *_lag_blocks(source, XS, key, SPEC.y, diff=True),
        ("rows_ok", f"SELECT * FROM design WHERE {_complete([SPEC.y, *XS])}"),
        *ols_sql("ind", "rows_ok", by, SPEC.y, XS),
        *ols_sql("com", "rows_ok", by, SPEC.y, ["animal"]),
    ]


def _stats() -> str:
    r2 = "1 - sse / nullif(sst, 0)"
    return ", ".join(
        [
            r(r2, 6, "r_squared"),
            r(f"1 - (1 - ({r2})) * (n - 1) / nullif(n - rank, 0)::DOUBLE", 6, "adj_r_squared"),
            r("n * ln(sse / n) + 2 * (rank + 1)", 6, "aic"),
        ]
    )


def _coef_rows(key: list[str], select) -> str:
    keys = "".join(f"{k}, " for k in key)
    parts = []
    for model, fit, terms in (
        ("Individual", "ind_fit", ["(Intercept)", *XS]),
        ("Combined", "com_fit", ["(Intercept)", "animal_incidence"]),
    ):
        for i, term in enumerate(terms):
            parts.append(f"SELECT {keys}lag, '{model}' AS model, {i} AS position, '{term}' AS term, {select(i)} FROM {fit}")
    return " UNION ALL ".join(parts)


def _national(spark, sf):
    return fx.national_months(spark, sf)


@query(
    "i4_lagged_ols",
    with_sql(
        _coef_rows([], lambda i: f"n, rank, {r(f'b{i}', 6, 'estimate')}, {r(f'se{i}', 6, 'std_error')}"),
        _models_blocks("national_months", []),
    ),
)
def i4(spark, sf):
    models = regression.lagged_ols(_national(spark, sf), "month")
    pairs = F.arrays_zip("terms", "coef", "se")
    long = models.select("lag", "model", "n", "rank", F.posexplode_outer(pairs).alias("position", "t"))
    return rounded(
        long.select(
            "lag",
            "model",
            "n",
            "rank",
            "position",
            F.col("t.terms").alias("term"),
            F.col("t.coef").alias("estimate"),
            F.col("t.se").alias("std_error"),
        )
    )


def _coef_select(i: int) -> str:
    t = f"b{i} / se{i}"
    lo, hi = f"round_even(b{i} - 1.645::DOUBLE * se{i}, 3)", f"round_even(b{i} + 1.645::DOUBLE * se{i}, 3)"
    r2 = "1 - sse / nullif(sst, 0)"
    cells = {
        "estimate": f"b{i}",
        "std_error": f"se{i}",
        "statistic": t,
        "p_value": t_p_value(f"({t})", "(n - rank)"),
        "conf_low": f"b{i} - 1.645::DOUBLE * se{i}",
        "conf_high": f"b{i} + 1.645::DOUBLE * se{i}",
        "adj_r_squared": f"1 - (1 - ({r2})) * (n - 1) / nullif(n - rank, 0)::DOUBLE",
    }
    shown = ", ".join(f"round_even({v}, 3) + 0.0::DOUBLE AS {k}" for k, v in cells.items())
    return (
        f"{shown}, {r(r2, 6, 'r_squared')}, {r('n * ln(sse / n) + 2 * (rank + 1)', 6, 'aic')}, "
        f"CASE WHEN se{i} IS NOT NULL THEN CASE WHEN {lo} * {hi} > 0 THEN 'Significant' ELSE 'Not Significant' END END AS significance"
    )


@query("i5_coef_table", with_sql(_coef_rows([], _coef_select), _models_blocks("national_months", [])))
def i5(spark, sf):
    table = regression.coef_table(regression.lagged_ols(_national(spark, sf), "month"), ["lag", "model"])
    return rounded(table)


def _stats_rows(key: list[str]) -> str:
    keys = "".join(f"{k}, " for k in key)
    return " UNION ALL ".join(
        f"SELECT {keys}lag, '{m}' AS model, n, rank, {_stats()} FROM {fit}"
        for m, fit in (("Individual", "ind_fit"), ("Combined", "com_fit"))
    )


@query("i6_fit_stats", with_sql(_stats_rows([]), _models_blocks("national_months", [])))
def i6(spark, sf):
    stats = regression.fit_stats(regression.lagged_ols(_national(spark, sf), "month"))
    return rounded(stats.select("lag", "model", "n", "rank", "r_squared", "adj_r_squared", "aic"))


def _accuracy(actual: str, fitted: str) -> str:
    e = f"({actual} - {fitted})"
    return ", ".join(
        [
            r(f"avg(abs({e}))", 6, "mae"),
            r(f"sqrt(avg({e} * {e}))", 6, "rmse"),
            r(f"avg(abs({e} / nullif({actual}, 0))) * 100", 6, "mape"),
        ]
    )


def _insample_sql() -> str:
    ind = "b0 + " + " + ".join(f"coalesce(b{i}, 0) * {x}" for i, x in enumerate(XS, 1))
    return with_sql(
        f"SELECT lag, 'Individual' AS model, {_accuracy(SPEC.y, 'fit')} FROM (SELECT lag, {SPEC.y}, {ind} AS fit FROM rows_ok JOIN ind_fit USING (lag)) GROUP BY lag"
        f" UNION ALL SELECT lag, 'Combined' AS model, {_accuracy(SPEC.y, 'fit')} FROM (SELECT lag, {SPEC.y}, b0 + coalesce(b1, 0) * animal AS fit FROM rows_ok JOIN com_fit USING (lag)) GROUP BY lag",
        _models_blocks("national_months", []),
    )


@query("i7_insample_accuracy", _insample_sql())
def i7(spark, sf):
    design = regression.lag_design(_national(spark, sf), [], "month", SPEC)
    models = regression.fit_lagged(design, [], SPEC)
    return rounded(
        regression.accuracy(regression.fitted(design, models, [], SPEC), SPEC.y, "fitted", ["lag", "model"])
    )


@query("i8_regional_ols", with_sql(_coef_rows(KEY, _coef_select), _models_blocks("regional_months", KEY)))
def i8(spark, sf):
    models = regression.lagged_ols(fx.regional_months(spark, sf), "month", key=KEY)
    return rounded(regression.coef_table(models, [*KEY, "lag", "model"]))


_NAMES = {
    "goat_incidence": "Goat Incidence",
    "catt_incidence": "Cattle incidence",
    "shp_incidence": "Sheep incidence",
    "cam_incidence": "Camel incidence",
    "animal_incidence": "Total animal incidence",
}


@query(
    "i9_forest_table",
    with_sql(
        "SELECT *, CASE term "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items())
        + f" END AS variable FROM ({_coef_rows([], _coef_select)}) WHERE position > 0 ORDER BY lag, model, position",
        _models_blocks("national_months", []),
    ),
)
def i9(spark, sf):
    table = regression.coef_table(regression.lagged_ols(_national(spark, sf), "month"), ["lag", "model"])
    return rounded(regression.forest_table(table)).orderBy("lag", "model", "position")


@query(
    "o2_rank_models",
    with_sql(
        "SELECT region, lag, "
        + r("aic")
        + ", (row_number() OVER (PARTITION BY region ORDER BY aic, lag))::INT AS place FROM (SELECT region, lag, n * ln(sse / n) + 2 * (rank + 1) AS aic FROM com_fit)",
        _models_blocks("regional_months", KEY),
    ),
)
def o2(spark, sf):
    stats = regression.fit_stats(regression.lagged_ols(fx.regional_months(spark, sf), "month", key=KEY))
    ranked = regression.rank_models(stats.where(F.col("model") == regression.COMBINED), KEY)
    return rounded(ranked.select("region", "lag", "aic", "place"))


def _shared_blocks() -> list[tuple[str, str]]:
    """The model blocks on the months that every lag has."""
    lags = len(SPEC.lags)
    own = f" QUALIFY count(*) OVER (PARTITION BY region, month) = {lags}"
    return [(name, body + own if name == "rows_ok" else body) for name, body in _models_blocks("regional_months", KEY)]


@query(
    "o2_rank_models_shared",
    with_sql(
        "SELECT region, lag, n, "
        + r("aic")
        + ", (row_number() OVER (PARTITION BY region ORDER BY aic, lag))::INT AS place FROM (SELECT region, lag, n, n * ln(sse / n) + 2 * (rank + 1) AS aic FROM com_fit)",
        _shared_blocks(),
    ),
)
def o2_shared(spark, sf):
    """Ranked on one sample, so that the criteria of different lags compare."""
    models = regression.lagged_ols(fx.regional_months(spark, sf), "month", key=KEY, shared=True)
    stats = regression.fit_stats(models).where(F.col("model") == regression.COMBINED)
    return rounded(regression.rank_models(stats, KEY).select("region", "lag", "n", "aic", "place"))


# ---------------------------------------------------------------- count models

_COUNT_ITERATIONS = 12


def _poisson_sql(final: str, combined: bool, regional: bool = False) -> str:
    """Newton steps for the count model, unrolled; each solves the weighted normal equations by sweeping.

    With ``regional`` the key called lag is region and lag in one text.
    """
    key = "region || '|' || lag AS lag" if regional else "lag"
    xs = ["animal_cases"] if combined else [f"{s}_cases" for s in SERIES[1:]]
    raw = [f"{s}_cases" for s in SERIES[1:]]
    steps = _lag_blocks("counted", raw, KEY, "hum_cases", diff=False)
    blocks: list[tuple[str, str]] = [
        ("counted", f"SELECT c.region, c.month, {', '.join(f'c.{s}_cases' for s in SERIES)} FROM regional_counts c"),
        *steps,
        (
            "coded",
            "SELECT region, month, year(month) AS year, dense_rank() OVER (PARTITION BY region ORDER BY month)::DOUBLE AS time_code FROM counted",
        ),
        (
            "full_rows",
            f"SELECT g.region, g.month, g.lag, g.hum_cases::DOUBLE AS y, {', '.join(f'g.{c}' for c in raw)}, g.animal AS animal_cases, c.time_code, ln(d.pop::DOUBLE) AS off "
            f"FROM design g JOIN coded c USING (region, month) JOIN den d ON d.region = g.region AND d.year = c.year WHERE {_complete([f'g.{c}' for c in raw])}",
        ),
        (
            "z",
            f"SELECT {key}, y, off, 1.0::DOUBLE AS x0, "
            + ", ".join(
                f"coalesce(({c} - avg({c}) OVER (PARTITION BY f.lag)) / nullif(stddev_samp({c}) OVER (PARTITION BY f.lag), 0), 0) AS x{i}"
                for i, c in enumerate(xs, 1)
            )
            + f", time_code AS x{len(xs) + 1} FROM full_rows f",
        ),
    ]
    k = len(xs) + 2
    start = "ln(sum(y) / sum(exp(off)))"
    blocks.append(("c0", f"SELECT lag, {start} AS b0, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(1, k))} FROM z GROUP BY lag"))
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]

    def cell(i: int, j: int) -> str:
        return f"a{min(i, j)}_{max(i, j)}"

    for step in range(_COUNT_ITERATIONS):
        eta = " + ".join(f"b{i} * x{i}" for i in range(k))
        v = [f"x{i}" for i in range(k)] + ["work"]
        sums = ", ".join(f"sum(mu * {v[i]} * {v[j]}) AS a{i}_{j}" for i, j in cells)
        blocks.append(
            (
                f"g{step}",
                f"SELECT lag, {sums} FROM (SELECT *, ({eta}) + (y - mu) / mu AS work FROM (SELECT z.*, c.* EXCLUDE (lag), exp(off + {eta}) AS mu FROM z JOIN c{step} c ON c.lag = z.lag)) GROUP BY lag",
            )
        )
        source = f"g{step}"
        for s in range(k):
            pivot = cell(s, s)
            out = []
            for i, j in cells:
                if i == s and j == s:
                    out.append(f"-1.0::DOUBLE / {pivot} AS a{i}_{j}")
                elif i == s or j == s:
                    other = j if i == s else i
                    out.append(f"{cell(other, s)} / {pivot} AS a{i}_{j}")
                else:
                    out.append(f"a{i}_{j} - {cell(i, s)} * {cell(j, s)} / {pivot} AS a{i}_{j}")
            blocks.append((f"g{step}_{s}", f"SELECT lag, {', '.join(out)} FROM {source}"))
            source = f"g{step}_{s}"
        blocks.append(
            (
                f"c{step + 1}",
                f"SELECT lag, {', '.join(f'a{i}_{k} AS b{i}' for i in range(k))} FROM {source}",
            )
        )
        if step == _COUNT_ITERATIONS - 1:
            blocks.append(("se", f"SELECT lag, {', '.join(f'sqrt(-a{i}_{i}) AS se{i}' for i in range(k))} FROM {source}"))
    eta = " + ".join(f"b{i} * x{i}" for i in range(k))
    last = f"c{_COUNT_ITERATIONS}"
    blocks.append(
        (
            "phi",
            f"SELECT lag, sum((y - mu) * (y - mu) / mu) / (count(*) - {k}) AS phi FROM (SELECT z.lag, y, exp(off + {eta}) AS mu FROM z JOIN {last} c ON c.lag = z.lag) GROUP BY lag",
        )
    )
    terms = ["(Intercept)", *xs, "time_code"]
    rows = " UNION ALL ".join(
        f"SELECT lag, '{t}' AS term, b{i} AS b, se{i} AS se, phi FROM {last} JOIN se USING (lag) JOIN phi USING (lag)"
        for i, t in enumerate(terms)
    )
    blocks.append(("coefs", rows))
    return with_sql(final, blocks)


def _count_panel(spark, sf):
    return fx.regional_months(spark, sf)


def _z_sql(z: str) -> str:
    """The statistic and its two-sided normal tail, by the midpoint rule over the angle of Craig's integral."""
    tail = f"list_sum(list_transform(range(0, 400), lambda j: exp(-({z}) * ({z}) / (2 * pow(sin((j + 0.5::DOUBLE) * pi() / 800), 2))))) / 400"
    return f"{r(z, 2, 'statistic')}, {r(tail, 2, 'p_value')}"


def _tested(df):
    return rounded(rounded(df, "statistic", "p_value", digits=2), *[c for c, kind in df.dtypes if kind == "double" and c not in ("statistic", "p_value")], digits=5)


@query(
    "i10_poisson_glm",
    _poisson_sql(
        f"SELECT lag, term, {r('b', 5, 'estimate')}, {r('se', 5, 'std_error')}, {_z_sql('b / se')}, true AS converged FROM coefs", combined=True
    ),
)
def i10(spark, sf):
    coefs = count_models.fit_count_model(_count_panel(spark, sf), count_models.CountSpec(combined=True))
    return _tested(coefs.select("lag", "term", "estimate", "std_error", "statistic", "p_value", "converged"))


@query(
    "i10_poisson_by_region",
    _poisson_sql(
        f"SELECT split_part(lag, '|', 1) AS region, split_part(lag, '|', 2)::INT AS lag, term, {r('b', 5, 'estimate')}, {r('se', 5, 'std_error')}, true AS converged FROM coefs",
        combined=True,
        regional=True,
    ),
)
def i10_by_region(spark, sf):
    """A fit of its own for every region and lag, all in one job an iteration."""
    coefs = count_models.fit_count_model(_count_panel(spark, sf), count_models.CountSpec(combined=True), by_region=True)
    return rounded(coefs.select("region", "lag", "term", "estimate", "std_error", "converged"), digits=5)


@query(
    "i11_overdispersed_counts",
    _poisson_sql(
        f"SELECT lag, term, {r('b', 5, 'estimate')}, {r('se * sqrt(phi)', 5, 'std_error')}, {r('phi', 5, 'dispersion')}, {_z_sql('b / (se * sqrt(phi))')} FROM coefs",
        combined=False,
    ),
)
def i11(spark, sf):
    coefs = count_models.fit_count_model(_count_panel(spark, sf), count_models.CountSpec(), "quasipoisson")
    return _tested(coefs.select("lag", "term", "estimate", "std_error", "dispersion", "statistic", "p_value"))


@query(
    "i12_rate_ratios",
    _poisson_sql(
        f"SELECT lag, term, {r('exp(b)', 5, 'rate_ratio')}, {r('exp(b - 1.645::DOUBLE * se)', 5, 'conf_low')}, {r('exp(b + 1.645::DOUBLE * se)', 5, 'conf_high')}, {_z_sql('b / se')} FROM coefs WHERE term NOT IN ('time_code', '(Intercept)')",
        combined=True,
    ),
)
def i12(spark, sf):
    coefs = count_models.fit_count_model(_count_panel(spark, sf), count_models.CountSpec(combined=True))
    return _tested(count_models.rate_ratios(coefs))


# ---------------------------------------------------------------- counts that vary more than Poisson counts


def _item_panel(spark, sf):
    """The regional panel with the number of line items as the human cases: they come in orders of one to seven."""
    items = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"))
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.trunc("o_orderdate", "month").alias("month"))
    customer = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    sold = orders.join(items, orders["o_orderkey"] == items["l_orderkey"]).join(customer, orders["o_custkey"] == customer["c_custkey"])
    counts = sold.groupBy("n_nationkey", "month").agg(F.sum("items").alias("items"))
    names = fx.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    panel = fx.regional_months(spark, sf).drop("hum_cases")
    return panel.join(counts.join(names, "n_nationkey").select("region", "month", F.col("items").alias("hum_cases")), ["region", "month"])


_LINEAR_ITERATIONS = 14


def _linear_sql() -> str:
    """Newton steps for coefficients and excess together; differences of digamma and trigamma as finite sums over the count."""
    base = _poisson_sql("SELECT 1", combined=True)
    text = base[: base.rindex("\nSELECT 1")]
    counts = """items AS (SELECT n.n_name AS region, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey GROUP BY ALL),
    counted AS (SELECT c.region, c.month, i.items AS hum_cases, c.catt_cases, c.cam_cases, c.goat_cases, c.shp_cases FROM regional_counts c JOIN items i USING (region, month))"""
    start, end = text.index("counted AS ("), text.index("),\n", text.index("counted AS (")) + 1
    text = text[:start] + counts + text[end:]
    k = 3  # intercept, cases, time; the excess comes fourth
    blocks = [f"e0 AS (SELECT c.*, ln(greatest(phi - 1, 0.01)) AS b{k} FROM c{_COUNT_ITERATIONS} c JOIN phi USING (lag))"]
    cells = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    cell = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    for step in range(_LINEAR_ITERATIONS):
        eta = " + ".join(f"b{i} * x{i}" for i in range(k))
        rows = f"SELECT z.*, c.* EXCLUDE (lag), ({eta}) AS eta, exp(off + {eta} - b{k}) AS a, exp(b{k}) AS e FROM z JOIN e{step} c ON c.lag = z.lag"
        rows = f"SELECT *, e / (1 + e) AS s, a * (coalesce(list_sum(list_transform(range(0, y::BIGINT), lambda m: 1 / (a + m))), 0) - ln(1 + e)) AS d, a * a * coalesce(list_sum(list_transform(range(0, y::BIGINT), lambda m: 1 / ((a + m) * (a + m)))), 0) AS t FROM ({rows})"
        rows = f"SELECT *, t - d AS hee, d - t + a * s AS het, t - d - a * s * (1 + s) + y * s * (1 - s) AS htt, y * (1 - s) - a * s - d AS st FROM ({rows})"
        sums = []
        for i, j in cells:
            if j < k:
                e = f"hee * x{i} * x{j}"
            elif i < k and j == k:
                e = f"het * x{i}"
            elif i == k and j == k:
                e = "htt"
            elif i < k:
                e = f"(hee * eta + het * b{k} + d) * x{i}"
            else:
                e = f"(het * eta + htt * b{k} + st)" if i == k else "0.0::DOUBLE"
            sums.append(f"sum({e}) AS a{i}_{j}")
        blocks.append(f"l{step} AS (SELECT lag, any_value(b{k}) AS old, {', '.join(sums)} FROM ({rows}) GROUP BY lag)")
        source = f"l{step}"
        for p in range(k + 1):
            pivot, out = cell(p, p), []
            for i, j in cells:
                if i == p and j == p:
                    out.append(f"-1.0::DOUBLE / {pivot} AS a{i}_{j}")
                elif p in (i, j):
                    out.append(f"{cell(j if i == p else i, p)} / {pivot} AS a{i}_{j}")
                else:
                    out.append(f"a{i}_{j} - {cell(i, p)} * {cell(j, p)} / {pivot} AS a{i}_{j}")
            blocks.append(f"l{step}_{p} AS (SELECT lag, old, {', '.join(out)} FROM {source})")
            source = f"l{step}_{p}"
        found = ", ".join(f"a{i}_{k + 1} AS b{i}" for i in range(k))
        blocks.append(f"e{step + 1} AS (SELECT lag, {found}, greatest(least(greatest(a{k}_{k + 1}, old - 1), old + 1), ln(1e-6)) AS b{k}, {', '.join(f'sqrt(-a{i}_{i}) AS se{i}' for i in range(k))} FROM {source})")
    last = f"e{_LINEAR_ITERATIONS}"
    terms = " UNION ALL ".join(
        f"SELECT lag, '{t}' AS term, {r(f'b{i}', 5, 'estimate')}, {r(f'se{i}', 5, 'std_error')}, {r(f'1 + exp(b{k})', 5, 'dispersion')}, {_z_sql(f'b{i} / se{i}')}, true AS converged FROM {last}"
        for i, t in enumerate(["(Intercept)", "animal_cases", "time_code"])
    )
    return text + ",\n" + ",\n".join(blocks) + "\n" + terms


@query("i11_linear_variance", _linear_sql())
def i11_linear(spark, sf):
    coefs = count_models.fit_count_model(_item_panel(spark, sf), count_models.CountSpec(combined=True), "linear")
    return _tested(coefs.select("lag", "term", "estimate", "std_error", "dispersion", "statistic", "p_value", "converged"))


# ---------------------------------------------------------------- counts with effects of regions

_EFFECT_VARIANCE = 0.05
_EFFECT_ITERATIONS = 14


def _region_effects_sql(final: str, limited: bool) -> str:
    """Newton steps in which every region's level is solved for in its own sums; ``limited`` shrinks it by a variance."""
    base = _poisson_sql("SELECT 1", combined=True)
    text = base[: base.index(",\nz AS (")]
    k = 3  # 1, cases, time
    blocks = [
        "zr AS (SELECT region, lag, y, off, 1.0::DOUBLE AS x0, coalesce((animal_cases - avg(animal_cases) OVER w) / nullif(stddev_samp(animal_cases) OVER w, 0), 0) AS x1, time_code AS x2 FROM full_rows WINDOW w AS (PARTITION BY lag))",
        "k0 AS (SELECT lag, region, ln(any_value(level)) AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS u, count(*) AS n FROM zr JOIN (SELECT lag, sum(y) / sum(exp(off)) AS level FROM zr GROUP BY lag) USING (lag) GROUP BY lag, region)",
    ]
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    first = 0 if limited else 1
    share = f"{_EFFECT_VARIANCE}::DOUBLE / ({_EFFECT_VARIANCE}::DOUBLE * a0_0 + 1)" if limited else "1 / a0_0"
    for step in range(_EFFECT_ITERATIONS):
        eta = "c.b0 + c.b1 * x1 + c.b2 * x2 + c.u"
        v = ["x0", "x1", "x2", "work"]
        sums = ", ".join(f"sum(mu * {v[i]} * {v[j]}) AS {at(i, j)}" for i, j in cells)
        blocks.append(
            f"h{step} AS (SELECT lag, region, {sums} FROM (SELECT *, eta + (y - mu) / mu AS work FROM (SELECT z.*, {eta} AS eta, exp(off + {eta}) AS mu FROM zr z JOIN k{step} c ON c.lag = z.lag AND c.region = z.region)) GROUP BY lag, region)"
        )
        left = ", ".join(f"sum({at(i, j)} - {at(0, i)} * {at(0, j)} * {share}) AS {at(i, j)}" for i, j in cells)
        blocks.append(f"m{step}_{first} AS (SELECT lag, {left} FROM h{step} GROUP BY lag)")
        source = f"m{step}_{first}"
        for p in range(first, k):
            out = []
            for i, j in cells:
                if i == p and j == p:
                    out.append(f"-1.0::DOUBLE / {at(p, p)} AS {at(i, j)}")
                elif p in (i, j):
                    out.append(f"{at(j if i == p else i, p)} / {at(p, p)} AS {at(i, j)}")
                else:
                    out.append(f"{at(i, j)} - {at(i, p)} * {at(j, p)} / {at(p, p)} AS {at(i, j)}")
            blocks.append(f"m{step}_{p + 1} AS (SELECT lag, {', '.join(out)} FROM {source})")
            source = f"m{step}_{p + 1}"
        b = [f"s.{at(i, k)}" if i >= first else "0.0::DOUBLE" for i in range(k)]
        share_h = share.replace("a0_0", "h.a0_0")
        blocks.append(
            f"k{step + 1} AS (SELECT h.lag, h.region, {', '.join(f'{e} AS b{i}' for i, e in enumerate(b))}, ({share_h}) * (h.a0_3 - {b[0]} * h.a0_0 - {b[1]} * h.a0_1 - {b[2]} * h.a0_2) AS u, "
            f"sqrt({share_h}) AS u_se, h.a0_0 AS w, h.a0_1 / h.a0_0 AS m1, h.a0_2 / h.a0_0 AS m2, -s.a1_1 AS v11, -s.a1_2 AS v12, -s.a2_2 AS v22, c.n FROM h{step} h JOIN {source} s ON s.lag = h.lag JOIN k{step} c ON c.lag = h.lag AND c.region = h.region)"
        )
    last = f"k{_EFFECT_ITERATIONS}"
    return text + ",\n" + ",\n".join(blocks) + "\n" + final.replace("LAST", last)


@query(
    "i10_region_effects",
    _region_effects_sql(
        f"SELECT lag, region, {r('u', 5, 'effect')}, {r('u_se', 5, 'effect_se')}, {r('b0', 5, 'level')}, {r('b1', 5, 'slope')}, {r('b2', 5, 'time_slope')}, {_EFFECT_VARIANCE}::DOUBLE AS variance, true AS converged FROM LAST",
        limited=True,
    ),
)
def i10_effects(spark, sf):
    """Levels of regions, drawn to 0 by a given variance."""
    spec = count_models.CountSpec(combined=True)
    design = materialise(count_models.count_design(_count_panel(spark, sf), spec), "count-design")
    found = count_models.fit_region_effects(design, spec, _EFFECT_VARIANCE, tolerance=1e-9)
    coef = [F.element_at("coef", i).alias(n) for i, n in enumerate(("level", "slope", "time_slope"), 1)]
    return rounded(found.select("lag", "region", "effect", "effect_se", *coef, F.col("g00").alias("variance"), "converged"), digits=5)


_SPREAD = "{d1} * {d1} * v11 + 2 * {d1} * {d2} * v12 + {d2} * {d2} * v22"


@query(
    "i10_region_dummies",
    _region_effects_sql(
        "SELECT lag, term, "
        + f"{r('estimate', 5)}, {r('std_error', 5)}, true AS converged FROM ("
        + "SELECT lag, 'animal_cases' AS term, any_value(b1) AS estimate, sqrt(any_value(v11)) AS std_error FROM LAST GROUP BY lag "
        + "UNION ALL SELECT lag, 'time_code', any_value(b2), sqrt(any_value(v22)) FROM LAST GROUP BY lag "
        + f"UNION ALL SELECT lag, '(Intercept)', u, sqrt(1 / w + {_SPREAD.format(d1='m1', d2='m2')}) FROM LAST QUALIFY row_number() OVER (PARTITION BY lag ORDER BY n DESC, region DESC) = 1 "
        + f"UNION ALL SELECT a.lag, 'region_' || a.region, a.u - o.u, sqrt(1 / a.w + 1 / o.w + {_SPREAD.format(d1='(a.m1 - o.m1)', d2='(a.m2 - o.m2)').replace('v11', 'a.v11').replace('v12', 'a.v12').replace('v22', 'a.v22')}) "
        + "FROM LAST a JOIN (SELECT * FROM LAST QUALIFY row_number() OVER (PARTITION BY lag ORDER BY n DESC, region DESC) = 1) o ON o.lag = a.lag WHERE a.region <> o.region)",
        limited=False,
    ),
)
def i10_dummies(spark, sf):
    """A term for each region but one, found without a column for any."""
    coefs = count_models.fit_count_model(_count_panel(spark, sf), count_models.CountSpec(combined=True, region_effects=True))
    return rounded(coefs.select("lag", "term", "estimate", "std_error", "converged"), digits=5)
