"""Autoregressive forecasts for any number of series in one job.

Order selection, coefficients, forecasts and interval widths of a series are
columns of one row, so there is no job per series, per order or per step. In ``fit_ar`` the
candidate orders are nested: one cross-product aggregate and one factorisation give
the residual sum of squares of each of them. ``fit_ar_errors`` is a regression with
autoregressive errors by exact likelihood: one aggregate gives each series' sums of
products, and batches of them are fitted together (``functions.ar_likelihood``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from panelspark.functions import ar_likelihood, arma_css
from panelspark.functions.linalg import add_steps, back_steps, factor_steps, intercept_text, normal_equations
from panelspark.operators.joins import join_same
from panelspark.operators.regression import accuracy
from panelspark.operators.windows import series_window
from panelspark.session import reach_workers

# standard normal quantiles of the two-sided 80 % and 95 % limits
Z_80, Z_95 = 1.2815515655446004, 1.959963984540054


def _lag_names(max_p: int) -> list[str]:
    return [f"_y{j}" for j in range(1, max_p + 1)]


def ar_design(
    df: DataFrame, key: Sequence[str], month: str, y: str, max_p: int, d: int = 0, xreg: str | None = None
) -> DataFrame:
    """Rows with the (possibly differenced) target ``_y``, its lags, the regressor ``_x`` and the level before."""
    if d not in (0, 1):
        raise ValueError("d is 0 or 1")
    w = series_window(key, month)
    rows = df.select(
        *key, month, F.col(y).cast("double").alias("_v"), *([F.col(xreg).cast("double").alias("_x")] if xreg else [])
    ).dropna()
    rows = rows.withColumn("_before", F.lag("_v", 1).over(w) if d else F.lit(0.0))
    rows = rows.withColumn("_y", F.col("_v") - F.col("_before"))
    if xreg and d:
        rows = rows.withColumn("_x", F.col("_x") - F.lag("_x", 1).over(w))
    return rows.withColumns({name: F.lag("_y", j).over(w) for j, name in enumerate(_lag_names(max_p), 1)})


def fit_ar(
    df: DataFrame,
    key: Sequence[str],
    month: str = "month",
    y: str = "value",
    max_p: int = 5,
    d: int = 0,
) -> DataFrame:
    """Least-squares autoregression per series, order 0 to ``max_p`` by AIC on a common sample.

    The model table has, per key: n, p, intercept, phi (array of ``max_p``, zeros
    above p), beta (0: no regressor), sigma2, aic, and the state forecasts start from:
    last month, last level, last values of the target (newest first).
    """
    design = ar_design(df, key, month, y, max_p, d)
    lags = xs = _lag_names(max_p)
    k = len(xs)

    state = F.struct(
        F.col(month).alias("last_month"),
        F.col("_v").alias("last_level"),
        F.array(F.col("_y"), *[F.col(c) for c in lags[:-1]]).alias("recent"),
        (F.col("_v") * 0.0).alias("_pad"),
    )
    usable = design.dropna(subset=["_y", *xs])
    ne = normal_equations(usable, key, "_y", xs, extra=[F.max_by(state, month).alias("_state")])

    paths = []
    sse = "_syy"
    for size in range(k + 1):
        if size:
            sse = f"{sse} - _z{size - 1} * _z{size - 1}"
        aic = (
            f"CASE WHEN n > {size + 1} THEN n * ln(try_divide(greatest({sse}, _syy * 1e-15D), CAST(n AS DOUBLE)))"
            f" + {2.0 * (size + 2)}D END"
        )
        paths.append(f"named_struct('aic', coalesce({aic}, DOUBLE('Infinity')), 'p', {size}, 'sse', greatest({sse}, 0D))")
    steps = factor_steps(k)
    steps["_best"] = f"array_min(array({', '.join(paths)}))"
    steps["_p"] = "_best.p"
    steps |= back_steps(k, keep=lambda j: f"{j} < _p")
    ne = add_steps(ne, steps)
    free = F.col("n") - F.col("_best.p") - F.lit(1)
    return ne.select(
        *key,
        "n",
        F.col("_best.p").alias("p"),
        F.lit(d).alias("d"),
        F.expr(intercept_text(k)).alias("intercept"),
        F.array(*[F.col(f"_b{j}") for j in range(max_p)]).alias("phi"),
        F.lit(0.0).alias("beta"),
        F.try_divide(F.col("_best.sse"), F.when(free > 0, free)).alias("sigma2"),
        F.when(F.col("_best.aic") < F.lit(float("inf")), F.col("_best.aic")).alias("aic"),
        F.col("_state.last_month").alias("last_month"),
        F.col("_state.last_level").alias("last_level"),
        F.col("_state.recent").alias("recent"),
    )


def _products(
    df: DataFrame, key: Sequence[str], month: str, y: str, xreg: str | None, size: int, d: int
) -> DataFrame:
    """Per series: n, means, sums of centred products at lags below ``size``, the outermost values at both ends, and the last month, level and regressor."""
    w = series_window(key, month)
    x = F.col(xreg).cast("double") if xreg else F.lit(0.0)
    rows = df.select(*key, month, F.col(y).cast("double").alias("_v"), x.alias("_r")).dropna(subset=["_v", "_r"])
    target = {"_y": "_v", "_x": "_r"}
    rows = rows.withColumns({new: F.col(old) - F.lag(old, 1).over(w) if d else F.col(old) for new, old in target.items()})
    rows = rows.where(F.col("_y").isNotNull())
    whole = Window.partitionBy(*key)
    rows = rows.withColumns(
        {
            "_t": F.row_number().over(w),
            "_n": F.count(F.lit(1)).over(whole),
            "_my": F.avg("_y").over(whole),
            "_mx": F.avg("_x").over(whole),
        }
    ).withColumns({"_y": F.col("_y") - F.col("_my"), "_x": F.col("_x") - F.col("_mx")})
    pairs = [(a, b, h) for a in ("_y", "_x") for b in ("_y", "_x") for h in range(size)]
    names = {(a, h): f"{a}{h}" for a, _, h in pairs}
    rows = rows.withColumns({name: F.lag(a, h).over(w) if h else F.col(a) for (a, h), name in names.items()})
    sums = F.array(*[F.coalesce(F.sum(F.col(names[a, h]) * F.col(b)), F.lit(0.0)) for a, b, h in pairs])
    outer = F.when((F.col("_t") <= size) | (F.col("_t") > F.col("_n") - size), F.struct("_t", "_y", "_x"))
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_my").alias("_my"),
        F.max("_mx").alias("_mx"),
        sums.alias("_sums"),
        F.collect_list(outer).alias("_ends"),
        F.max_by(F.struct(F.col(month).alias("last_month"), F.col("_v").alias("last_level"), F.col("_r").alias("last_x")), month).alias("_last"),
    )


def fit_ar_errors(
    df: DataFrame,
    key: Sequence[str],
    month: str = "month",
    y: str = "value",
    xreg: str | None = None,
    max_p: int = 5,
    d: int = 0,
    steps: int = 100,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Regression of ``y`` on ``xreg`` with autoregressive errors, exact likelihood, order 0 to ``max_p`` by AIC.

    The model table is that of ``fit_ar`` with the regressor's slope ``beta`` and two columns more:
    ``passes`` that changed a slope or partial autocorrelation by more than ``tolerance``,
    and ``converged``, whether the last of the ``steps`` passes did not. ``recent`` and ``intercept`` are those of the series
    less beta times the regressor. All orders use the same months, those without a null. A regressor that never
    varies has slope 0; a series too short for any order has its mean for a forecast and no AIC.
    """
    if d not in (0, 1):
        raise ValueError("d is 0 or 1")
    size = max_p + 1
    stats = _products(df, key, month, y, xreg, size, d)
    numbers = ["n", "_my", "_mx"]
    kept = [*key, "_last"]

    def solve(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = batch.num_rows
        n, my, mx = (batch[c].to_numpy(zero_copy_only=False) for c in numbers)
        sums = batch["_sums"].flatten().to_numpy().reshape(rows, 2, 2, size)
        products = {(a, b): sums[:, i, j] for i, a in enumerate("yx") for j, b in enumerate("yx")}
        ends = batch["_ends"].flatten()
        row = np.repeat(np.arange(rows), np.diff(batch["_ends"].offsets.to_numpy()))
        t = ends.field("_t").to_numpy() - 1
        back = n[row] - 1 - t
        first, last = ({a: np.zeros((rows, size)) for a in "yx"} for _ in range(2))
        for a in "yx":
            value = ends.field(f"_{a}").to_numpy()
            first[a][row[t < size], t[t < size]] = value[t < size]
            last[a][row[back < size], back[back < size]] = value[back < size]
        made = ar_likelihood.best_order(
            ar_likelihood.product_sums(products, first, last, n), n, max_p, xreg is not None, steps, tolerance
        )
        beta = made["beta"]
        level = made["c"] + my - beta * mx
        recent = last["y"] + my[:, None] - beta[:, None] * (last["x"] + mx[:, None])
        free = n - made["p"] - (2 if xreg else 1)
        sigma2 = made["sse"] / np.where(free > 0, free, 1)
        lists = lambda m: pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * max_p, m[:, :max_p].reshape(-1))
        return [
            pa.array(made["p"].astype(np.int32)),
            pa.array(level * (1 - made["phi"].sum(1))),
            lists(made["phi"]),
            pa.array(beta),
            pa.array(sigma2, mask=free <= 0),
            pa.array(made["aic"], mask=~np.isfinite(made["aic"])),
            lists(recent),
            pa.array(made["used"]),
            pa.array(made["converged"]),
        ]

    names = ["p", "intercept", "phi", "beta", "sigma2", "aic", "recent", "passes", "converged"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.select([*kept, "n"]).columns, *solve(batch)], [*kept, "n", *names])

    schema = stats.select(*kept, "n").schema
    for name, kind in zip(names, ["int", "double", "array<double>", "double", "double", "double", "array<double>", "long", "boolean"]):
        schema = schema.add(name, DataType.fromDDL(kind))
    reach_workers(df.sparkSession)
    return stats.mapInArrow(run, schema).select(*key, "n", "p", F.lit(d).alias("d"), *names[1:6], "_last.*", *names[6:])


def fit_arma(
    df: DataFrame,
    key: Sequence[str],
    month: str = "month",
    y: str = "value",
    max_p: int = 2,
    max_q: int = 1,
    d: int = 0,
    passes: int = 40,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Autoregression with moving-average terms by conditional least squares, orders up to (``max_p``, ``max_q``) by AIC on the same months.

    The model table is that of ``fit_ar`` with q, ``theta`` and ``shocks`` (the last residuals, newest first),
    and ``converged``: whether the step after the last of the ``passes`` would change a coefficient by less than
    ``tolerance`` of one plus its size. A series is one row while it is fitted; two rows for one month fail the job.
    """
    if d not in (0, 1):
        raise ValueError("d is 0 or 1")
    rows = df.select(*key, month, F.col(y).cast("double").alias("_v")).dropna(subset=[month, "_v"])
    rows = rows.withColumn("_y", F.col("_v") - F.lag("_v", 1).over(series_window(key, month)) if d else F.col("_v"))
    cells = F.struct(F.col(month).alias("month"), F.col("_y").alias("y"), F.col("_v").alias("v"))
    whole = rows.where(F.col("_y").isNotNull()).groupBy(*key).agg(F.sort_array(F.collect_list(cells)).alias("_s"))
    same = F.size(F.array_distinct(F.col("_s.month"))) == F.size("_s")
    checked = F.when(same, F.col("_s")).otherwise(F.raise_error(F.lit("two rows for one month of a series")).cast(whole.schema["_s"].dataType))
    last = F.element_at("_s", -1)
    state = [last["month"].alias("last_month"), last["v"].alias("last_level")]
    whole = whole.select(*key, checked.alias("_s")).select(*key, F.size("_s").cast("long").alias("n"), *state, F.col("_s.y").alias("_y"))
    kept = [*key, "n", "last_month", "last_level"]

    def run(batches):
        for batch in batches:
            # few rows at a time: they are padded to the longest
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [np.array(v, float) for v in part["_y"].to_pylist()]
                n = np.array([len(v) for v in lists], np.int64)
                series = np.zeros((len(lists), max(int(n.max()), max_p + 1)))
                for i, v in enumerate(lists):
                    series[i, : len(v)] = v
                made = arma_css.best_order(series, n, max_p, max_q, passes, tolerance)
                recent = np.array([np.pad(v[::-1][:max_p], (0, max(0, max_p - len(v)))) for v in lists]).reshape(len(lists), max_p)
                free = n - max_p - made["p"] - made["q"] - 1
                listed = lambda m, size: pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * size, np.ascontiguousarray(m).reshape(-1))
                columns = [
                    pa.array(made["p"].astype(np.int32)),
                    pa.array(made["q"].astype(np.int32)),
                    pa.array(np.where(np.isfinite(made["aic"]), made["c"], [v.mean() for v in lists])),
                    listed(made["phi"], max_p),
                    listed(made["theta"], max_q),
                    pa.array(made["sse"] / np.where(free > 0, free, 1), mask=(free <= 0) | ~np.isfinite(made["aic"])),
                    pa.array(made["aic"], mask=~np.isfinite(made["aic"])),
                    listed(recent, max_p),
                    listed(made["shocks"], max_q),
                    pa.array(made["converged"]),
                ]
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, *columns], [*kept, *names])

    kinds = {
        "p": "int", "q": "int", "intercept": "double", "phi": "array<double>", "theta": "array<double>", "sigma2": "double",
        "aic": "double", "recent": "array<double>", "shocks": "array<double>", "converged": "boolean",
    }
    names, schema = list(kinds), whole.select(*kept).schema
    for name, kind in kinds.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    reach_workers(df.sparkSession)
    return whole.mapInArrow(run, schema).withColumns({"d": F.lit(d), "beta": F.lit(0.0)})


def arma_forecast(
    parts: DataFrame, key: Sequence[str], month: str, y: str, max_p: int = 2, max_q: int = 1, d: int = 0, passes: int = 40
) -> DataFrame:
    """Hold-out forecasts by ``fit_arma``, the point forecast rounded to 3 decimals."""
    train, test = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "test")
    models = fit_arma(train, key, month, y, max_p, max_q, d, passes)
    paths = forecast(models, key, max_p, future=test.select(*key, month), month=month, d=d, max_q=max_q)
    return join_same(paths, test.select(*key, month, F.col(y).alias("actual")), [*key, month]).withColumn(
        "forecast", F.bround("forecast", 3)
    )


def _weighted(phi: Column, newest_first: Column, max_p: int) -> Column:
    out = F.lit(0.0)
    for j in range(1, max_p + 1):
        out = out + F.element_at(phi, j) * F.element_at(newest_first, j)
    return out


def forecast(
    models: DataFrame,
    key: Sequence[str],
    max_p: int,
    horizon: int | str = 12,
    future: DataFrame | None = None,
    month: str = "month",
    xreg: str | None = None,
    d: int = 0,
    last_x: str = "last_x",
    max_q: int = 0,
) -> DataFrame:
    """Point forecasts with 80 % and 95 % limits by step.

    Without ``future`` the months after the last one are forecast. With it, its
    months (and regressor values) are; a series' future is one array in its row.
    The recursion is that of the series less beta times the regressor, which is added to each point.
    With ``max_q`` the models have moving-average terms (``theta``, ``shocks``); later shocks are 0.
    Interval widths come from the cumulated squares of the moving-average weights.
    """
    rows = models
    if future is not None:
        cols = [F.col(month)] + ([F.col(xreg).cast("double").alias("_x")] if xreg else [])
        ahead = future.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_ahead"))
        rows = join_same(rows, ahead, list(key)) if key else rows.withColumn("_ahead", ahead.scalar())
        rows = rows.withColumn("_months", F.col("_ahead")[month]).withColumn("_h", F.size("_ahead"))
        if xreg:
            rows = rows.withColumn("_xs", F.col("_ahead")["_x"])
            if d:
                start = F.col(last_x)
                rows = rows.withColumn(
                    "_xs",
                    F.zip_with(
                        F.col("_xs"),
                        F.slice(F.concat(F.array(start), F.col("_xs")), F.lit(1), F.size("_xs")),
                        lambda a, b: a - b,
                    ),
                )
    else:
        steps = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
        rows = rows.withColumn("_h", steps.cast("int")).withColumn(
            "_months",
            F.transform(F.sequence(F.lit(1), F.col("_h")), lambda i: F.add_months(F.col("last_month"), i)),
        )

    impulse = F.array(F.lit(1.0), *[F.lit(0.0)] * (max_p - 1)) if max_p else F.array().cast("array<double>")
    start = F.struct(
        F.col("recent").alias("recent"),
        F.col("last_level").alias("level"),
        impulse.alias("psi"),
        F.lit(1.0).alias("weight"),
        F.lit(1.0).alias("spread"),
        F.array().cast("array<struct<point:double,spread:double>>").alias("out"),
        *([F.col("shocks").alias("shocks")] if max_q else []),
    )

    def step(acc: Column, i: Column) -> Column:
        value = F.col("intercept") + _weighted(F.col("phi"), acc["recent"], max_p)
        if max_q:
            value = value + _weighted(F.col("theta"), acc["shocks"], max_q)
        shown = value + F.col("beta") * F.element_at(F.col("_xs"), i) if xreg else value
        point = acc["level"] + shown if d else shown
        # weights of the next step; on differences the weights accumulate
        psi = _weighted(F.col("phi"), acc["psi"], max_p)
        if max_q:
            psi = psi + F.coalesce(F.get(F.col("theta"), i - 1), F.lit(0.0))
        weight = acc["weight"] + psi if d else psi
        push = lambda arr, v, size=max_p: F.slice(F.concat(F.array(v), arr), 1, size)
        shocks = [push(acc["shocks"], F.lit(0.0), max_q).alias("shocks")] if max_q else []
        return F.struct(
            push(acc["recent"], value).alias("recent"),
            point.alias("level"),
            push(acc["psi"], psi).alias("psi"),
            weight.alias("weight"),
            (acc["spread"] + weight * weight).alias("spread"),
            F.concat(acc["out"], F.array(F.struct(point.alias("point"), acc["spread"].alias("spread")))).alias("out"),
            *shocks,
        )

    path = F.aggregate(F.sequence(F.lit(1), F.col("_h")), start, step, lambda acc: acc["out"])
    steps = rows.withColumn("_path", path).select(
        *key, "sigma2", "_months", F.posexplode_outer("_path").alias("_i", "_s")
    )
    width = F.sqrt(F.col("sigma2") * F.col("_s.spread"))
    return steps.select(
        *key,
        F.element_at("_months", F.col("_i") + 1).alias(month),
        (F.col("_i") + 1).alias("step"),
        F.col("_s.point").alias("forecast"),
        *[
            (F.col("_s.point") + F.lit(sign * z) * width).alias(name)
            for name, sign, z in (
                ("lower_80", -1, Z_80),
                ("upper_80", 1, Z_80),
                ("lower_95", -1, Z_95),
                ("upper_95", 1, Z_95),
            )
        ],
    )


def fitted_values(
    df: DataFrame,
    models: DataFrame,
    key: Sequence[str],
    max_p: int,
    month: str = "month",
    y: str = "value",
    d: int = 0,
    xreg: str | None = None,
) -> DataFrame:
    """Fitted value and residual per training month, on the scale of ``y``."""
    design = ar_design(df, key, month, y, max_p, d, xreg)
    if xreg:
        w = series_window(key, month)
        design = design.withColumns({f"_x{j}": F.lag("_x", j).over(w) for j in range(1, max_p + 1)})
    sides = models.select(*key, "intercept", "phi", "beta")
    if key:
        rows = join_same(design, sides, list(key))
    else:
        one = sides.select(F.struct("intercept", "phi", "beta")).scalar()
        rows = design.withColumn("_one", one).select("*", "_one.*")
    value = F.col("_before") + F.col("intercept")
    for j, name in enumerate(_lag_names(max_p), 1):
        earlier = F.col(name) - F.col("beta") * F.col(f"_x{j}") if xreg else F.col(name)
        value = value + F.element_at("phi", j) * earlier
    if xreg:
        value = value + F.col("beta") * F.col("_x")
    return rows.select(*key, month, F.col("_v").alias(y), value.alias("fitted")).withColumn(
        "residual", F.col(y) - F.col("fitted")
    )


def xreg_lags(
    parts: DataFrame, key: Sequence[str], month: str, y: str, xreg: str, lags: Sequence[int], lag_test: bool = True
) -> DataFrame:
    """One row per (row, lag) with the regressor ``lag`` rows earlier.

    The whole series is lagged before the split, so a test month meets the value its
    coefficient belongs to. ``lag_test=False`` leaves the test part's regressor unlagged.
    """
    w = series_window(key, month)
    values = [
        F.struct(
            F.lit(n).alias("lag"),
            (
                F.lag(xreg, n).over(w)
                if lag_test
                else F.when(F.col("part") == "train", F.lag(xreg, n).over(w)).otherwise(F.col(xreg))
            ).alias("_xlag"),
        )
        for n in lags
    ]
    return parts.withColumn("_lags", F.array(*values)).select(*key, month, y, "part", F.inline_outer("_lags"))


def arx_forecast(
    parts: DataFrame,
    key: Sequence[str],
    month: str,
    y: str,
    xreg: str,
    lags: Sequence[int] = tuple(range(7)),
    max_p: int = 5,
    lag_test: bool = True,
) -> DataFrame:
    """Hold-out forecasts with the lagged regressor and autoregressive errors, all lags in one job.

    ``parts`` comes from ``rows.holdout``. Rows: key, lag, month, step, forecast,
    limits and the actual value; the point forecast is rounded to 3 decimals.
    """
    stacked = xreg_lags(parts, key, month, y, xreg, lags, lag_test)
    keys = [*key, "lag"]
    models = fit_ar_errors(stacked.where(F.col("part") == "train"), keys, month, y, "_xlag", max_p)
    test = stacked.where(F.col("part") == "test")
    paths = forecast(models, keys, max_p, future=test, month=month, xreg="_xlag")
    return join_same(paths, test.select(*keys, month, F.col(y).alias("actual")), [*keys, month]).withColumn(
        "forecast", F.bround("forecast", 3)
    )


def ar_forecast(
    parts: DataFrame, key: Sequence[str], month: str, y: str, max_p: int = 5, d: int = 0, exact: bool = False
) -> DataFrame:
    """Hold-out forecasts of the series from its own past; ``exact``: by likelihood, as with a regressor."""
    train, test = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "test")
    models = fit_ar_errors(train, key, month, y, None, max_p, d) if exact else fit_ar(train, key, month, y, max_p, d)
    paths = forecast(models, key, max_p, future=test.select(*key, month), month=month, d=d)
    return join_same(paths, test.select(*key, month, F.col(y).alias("actual")), [*key, month]).withColumn(
        "forecast", F.bround("forecast", 3)
    )


def model_comparison(plain: DataFrame, with_xreg: DataFrame, key: Sequence[str] = (), lag: int = 1) -> DataFrame:
    """Accuracy of the forecast without and with the regressor, a row each."""
    a = accuracy(plain, "actual", "forecast", key).withColumn("model", F.lit("Model with no exogenous variable"))
    b = accuracy(with_xreg.where(F.col("lag") == lag), "actual", "forecast", key).withColumn(
        "model", F.lit("Model with exogenous variable")
    )
    cols = [*key, "model", "mae", "rmse", "mape"]
    return a.select(*cols).unionByName(b.select(*cols))


def residual_pairs(residuals: DataFrame, key: Sequence[str], month: str, col: str = "residual") -> DataFrame:
    """(value before, value) pairs of the residual series."""
    before = F.lag(col, 1).over(series_window(key, month))
    return residuals.select(*key, month, before.alias("previous"), F.col(col).alias("current")).dropna()


def residual_histogram(residuals: DataFrame, key: Sequence[str], col: str = "residual", max_bins: int = 500) -> DataFrame:
    """Counts per bin of Freedman-Diaconis width (2 IQR n^(-1/3)), at most ``max_bins`` bins a series.

    The quartiles are of one series' months.
    """
    stats = residuals.groupBy(*key).agg(
        F.count(col).alias("_n"),
        F.min(col).alias("_lo"),
        F.max(col).alias("_hi"),
        F.percentile(col, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
    )
    width = 2 * (F.col("_q")[1] - F.col("_q")[0]) / F.pow(F.col("_n").cast("double"), F.lit(1 / 3))
    bins = F.greatest(
        F.least(F.ceil(F.try_divide(F.col("_hi") - F.col("_lo"), width)), F.lit(max_bins)), F.lit(1)
    ).cast("long")
    stats = stats.withColumn("n_bins", F.coalesce(bins, F.lit(1))).drop("_q")
    rows = (
        join_same(residuals, stats, list(key))
        if key
        else residuals.withColumn("_one", stats.select(F.struct("*")).scalar()).select(*residuals.columns, "_one.*")
    )
    span = F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    place = F.least(F.floor(F.coalesce(span, F.lit(0.0)) * F.col("n_bins")) + 1, F.col("n_bins"))
    return (
        rows.where(F.col(col).isNotNull())
        .groupBy(*key, "n_bins", "_lo", "_hi", place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            *key,
            "n_bins",
            "bin",
            (F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / F.col("n_bins")).alias("low"),
            (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / F.col("n_bins")).alias("high"),
            "count",
        )
    )
