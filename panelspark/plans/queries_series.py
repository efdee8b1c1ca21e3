"""Queries of the time-series operators (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import forecast as fc
from panelspark.operators import joins, regression, rollup, rows, series, windows
from panelspark.plans import fixture as fx
from panelspark.plans import panels
from panelspark.plans.oracle import CASES, POPS, RATE_EXPRS, ROUND_RATES, ols_sql, r, with_sql
from panelspark.plans.registry import query, rounded
from panelspark.session import materialise, scratch_path

KEY = ["region"]
W = "(PARTITION BY region ORDER BY month)"
MAX_P = 2


def price_series(spark, sf):
    """Square root of the order value by region and month: the fractional series."""
    orders = fx.table(spark, sf, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("month"), "o_totalprice")
    customer = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    sums = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .groupBy("n_nationkey", "month")
        .agg(F.sqrt(F.sum("o_totalprice")).alias("value"))
    )
    names = fx.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    return sums.join(names, "n_nationkey").select("region", "month", "value")


def filled_series(spark, sf):
    return windows.fill_months(price_series(spark, sf), KEY, "month", ["value"], fill=0.0)


FILLED = (
    "filled",
    """SELECT s.region, s.month, coalesce(p.value, 0.0::DOUBLE) AS value FROM
    (SELECT region, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM price_series GROUP BY region) s
    LEFT JOIN price_series p ON p.region = s.region AND p.month = s.month""",
)
_TOTAL = "catt_incidence + cam_incidence + goat_incidence + shp_incidence"


@query(
    "t1_series_build",
    with_sql(
        f"SELECT region, month, {r('hum_incidence')}, {r(_TOTAL, 6, 'animal_incidence')} FROM regional_months WHERE month <= DATE '2001-06-01'"
    ),
)
def t1(spark, sf):
    return rounded(series.series_build(fx.regional_months(spark, sf), KEY, cutoff="2001-06-01"))


_LIMIT = 35


_T2_SQL = with_sql(
        f"SELECT year, month, {', '.join(f'{c}::DOUBLE AS {c}' for c in (CASES + ', ' + POPS).split(', '))}, {ROUND_RATES} FROM ("
        f"SELECT year, month, hum_cases::DOUBLE AS hum_cases, {CASES[len('hum_cases, '):]}, {POPS}, hum_incidence, catt_incidence, cam_incidence, goat_incidence, shp_incidence FROM national_months WHERE year < (SELECT max(year) FROM panel)"
        f" UNION ALL SELECT c.*, {POPS}, {RATE_EXPRS} FROM fixed c JOIN national_den d ON c.year = d.year)",
        [
            ("last", "SELECT * FROM national_counts WHERE year = (SELECT max(year) FROM panel)"),
            (
                "fixed",
                f"""SELECT year, month, CASE WHEN hum_cases > {_LIMIT} THEN (SELECT round_even(avg(hum_cases), 0) FROM last WHERE hum_cases < {_LIMIT})
                ELSE hum_cases END::DOUBLE AS hum_cases, catt_cases, cam_cases, goat_cases, shp_cases FROM last""",
            ),
        ],
    )


@query("t2_extend_series", _T2_SQL)
def t2(spark, sf):
    """The last year of the reports, prepared like a later delivery, below the years before it."""
    return rounded(panels.extend_series(*_t2_parts(spark, sf))).orderBy("month")


def _t2_parts(spark, sf):
    """The panel of the earlier years, and the last year prepared like a later delivery."""
    base = fx.base_panel(spark, sf)
    marked = base.withColumn("_last", base.agg(F.max("year")).scalar())
    earlier, later = marked.where("year < _last"), marked.where("year = _last")
    den = fx.denominators(spark, sf)
    human = later.select(*panels.PANEL_KEYS, "hum_cases")
    animal = later.select(*panels.PANEL_KEYS, *[c for c in rollup.CASES if c != "hum_cases"])
    new = panels.later_year(human, animal, den.drop("pop"), den.select("region", "year", "pop"), limit=_LIMIT)
    monthly = rollup.sum_by(earlier, ["year", "month"], rollup.CASES)
    return rows.rate_columns(joins.join_rolled_denominator(monthly, den, ["year"], rollup.POPS), rollup.RATE_PAIRS), new


@query("t2_append_year", _T2_SQL)
def t2_append(spark, sf):
    """The panel published by year; the last year arrives first with doubled counts, then corrected."""
    history, new = _t2_parts(spark, sf)
    path = scratch_path(spark, "panel-by-year")
    panels.publish_years(panels.extend_series(history), path)
    panels.publish_years(panels.extend_series(new).withColumn("hum_cases", F.col("hum_cases") * 2), path)
    panels.publish_years(panels.extend_series(new), path)
    return rounded(panels.read_years(spark, path))


@query(
    "t3_season_table",
    with_sql(
        f"SELECT region, year, month(month)::INT AS month_of_year, {r('sum(hum_incidence)', 6, 'hum_incidence')}"
        " FROM regional_months GROUP BY region, year, month(month)"
    ),
)
def t3(spark, sf):
    return rounded(series.season_table(fx.regional_months(spark, sf), KEY, "month", "hum_incidence"))


_F1, _F2 = "ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING", "ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING"


@query(
    "t4_decompose",
    with_sql(
        f"SELECT t.region, t.month, {r('value')}, {r('trend')}, {r('season')}, {r('value - trend - season', 6, 'remainder')} FROM t JOIN s ON t.region = s.region AND month(t.month) = s.m",
        [
            FILLED,
            (
                "t",
                f"SELECT region, month, value, CASE WHEN count(*) OVER a = 12 AND count(*) OVER b = 12 THEN (avg(value) OVER a + avg(value) OVER b) / 2 END AS trend FROM filled "
                f"WINDOW a AS (PARTITION BY region ORDER BY month {_F1}), b AS (PARTITION BY region ORDER BY month {_F2})",
            ),
            ("raw", "SELECT region, month(month) AS m, avg(value - trend) AS v FROM t GROUP BY region, month(month)"),
            ("s", "SELECT region, m, v - avg(v) OVER (PARTITION BY region) AS season FROM raw"),
        ],
    ),
)
def t4(spark, sf):
    return rounded(series.decompose(filled_series(spark, sf), KEY))


_STL_INNER, _STL_ROBUST = 2, 1


def _local_blocks(name: str, source: str, places: str, span: int, degree: int, keys: str, weighted: bool) -> tuple[str, str]:
    """Local regression in SQL: ``source`` (keys, i, v, rw, n) at the rows of ``places`` (keys, i, n)."""
    left = f"CASE WHEN {span} >= n THEN 1 ELSE least(greatest(i - {(span + 1) // 2} + 1, 1), n - {span} + 1) END"
    same = " AND ".join(f"s.{k} = p.{k}" for k in keys.split(", "))
    w = f"CASE WHEN abs(s.i - p.i) > 0.999::DOUBLE * h THEN 0 WHEN abs(s.i - p.i) <= 0.001::DOUBLE * h THEN 1 ELSE pow(1 - pow(abs(s.i - p.i) / h, 3), 3) END{' * s.rw' if weighted else ''}"
    line = "CASE WHEN sqrt(greatest(c, 0)) > 0.001::DOUBLE * (n - 1) THEN -a / c ELSE 0 END"
    value = f"(sy + {line} * (sdy - a * sy)) / sw" if degree else "sy / sw"
    return (
        name,
        f"SELECT {keys}, i, n, CASE WHEN sw > 0 THEN {value} END AS v FROM (SELECT *, sd / nullif(sw, 0) AS a, sdd / nullif(sw, 0) - pow(sd / nullif(sw, 0), 2) AS c FROM ("
        f"SELECT {', '.join('p.' + k for k in keys.split(', '))}, p.i, p.n, sum(w) AS sw, sum(w * d) AS sd, sum(w * d * d) AS sdd, sum(w * near) AS sy, sum(w * d * near) AS sdy FROM ("
        f"SELECT p.*, s.v AS near, (s.i - p.i)::DOUBLE AS d, ({w})::DOUBLE AS w FROM (SELECT *, greatest(i - lo, hi - i) + greatest({span} - n, 0) // 2 AS h FROM ("
        f"SELECT *, least(lo + {span} - 1, n) AS hi FROM (SELECT *, {left} AS lo FROM {places}))) p JOIN {source} s ON {same} AND s.i BETWEEN p.lo AND p.hi) p GROUP BY {', '.join('p.' + k for k in keys.split(', '))}, p.i, p.n))",
    )


def _stl_sql() -> str:
    blocks = [
        FILLED,
        ("y0", "SELECT region, month, value AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY region) AS n, 0.0::DOUBLE AS trend, 0.0::DOUBLE AS season, 1.0::DOUBLE AS rw FROM filled WINDOW w AS (PARTITION BY region ORDER BY month)"),
    ]
    at = "y0"
    for step in range(_STL_INNER * (_STL_ROBUST + 1)):
        s = f"_{step}"
        robust = step >= _STL_INNER
        blocks += [
            (f"sub{s}", f"SELECT region, (i - 1) % 12 AS m, (i - 1) // 12 + 1 AS i, y - trend AS v, rw, count(*) OVER (PARTITION BY region, (i - 1) % 12) AS n FROM {at}"),
            (f"subp{s}", f"SELECT region, m, unnest(range(0, any_value(n) + 2)) AS i, any_value(n) AS n FROM sub{s} GROUP BY region, m"),
            _local_blocks(f"subf{s}", f"sub{s}", f"subp{s}", 13, 0, "region, m", robust),
            (f"cyc{s}", f"SELECT f.region, f.i * 12 + f.m + 1 AS t, coalesce(f.v, o.v, e.v) AS v FROM subf{s} f LEFT JOIN sub{s} o ON o.region = f.region AND o.m = f.m AND o.i = f.i LEFT JOIN subf{s} e ON e.region = f.region AND e.m = f.m AND e.i = least(greatest(f.i, 1), f.n)"),
            (f"ma{s}", f"SELECT region, t, avg(v) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS v FROM cyc{s} QUALIFY count(*) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) = 12"),
            (f"mb{s}", f"SELECT region, t, avg(v) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS v FROM ma{s} QUALIFY count(*) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) = 12"),
            (f"mc{s}", f"SELECT region, t AS i, avg(v) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS v, count(*) OVER (PARTITION BY region) - 2 AS n FROM mb{s} QUALIFY count(*) OVER (PARTITION BY region ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3"),
            _local_blocks(f"low{s}", f"mc{s}", f"mc{s}", 13, 1, "region", False),
            (f"sea{s}", f"SELECT y.region, y.month, y.y, y.i, y.n, y.rw, c.v - l.v AS season FROM {at} y JOIN cyc{s} c ON c.region = y.region AND c.t = y.i + 12 JOIN low{s} l ON l.region = y.region AND l.i = y.i"),
            (f"des{s}", f"SELECT region, i, y - season AS v, rw, n FROM sea{s}"),
            _local_blocks(f"tre{s}", f"des{s}", f"des{s}", 21, 1, "region", robust),
            (f"new{s}", f"SELECT s.*, coalesce(t.v, s.y - s.season) AS trend FROM sea{s} s JOIN tre{s} t ON t.region = s.region AND t.i = s.i"),
        ]
        at = f"new{s}"
        if (step + 1) % _STL_INNER == 0 and step + 1 < _STL_INNER * (_STL_ROBUST + 1):
            blocks.append(
                (
                    f"wgt{s}",
                    f"SELECT * EXCLUDE (rw, size, cut), CASE WHEN size <= 0.001::DOUBLE * cut THEN 1 WHEN size <= 0.999::DOUBLE * cut THEN pow(1 - pow(size / cut, 2), 2) ELSE 0 END::DOUBLE AS rw FROM ("
                    f"SELECT *, abs(y - trend - season) AS size, 6 * quantile_cont(abs(y - trend - season), 0.5) OVER (PARTITION BY region) AS cut FROM {at})",
                )
            )
            at = f"wgt{s}"
    return with_sql(f"SELECT region, month, {r('y', 6, 'value')}, {r('trend')}, {r('season')}, {r('y - trend - season', 6, 'remainder')} FROM {at}", blocks)


@query("t4_decompose_local", _stl_sql())
def t4_local(spark, sf):
    return rounded(series.decompose_local(filled_series(spark, sf), KEY, inner=_STL_INNER, robust=_STL_ROBUST))


_CENTRED = (
    "centred",
    "SELECT region, month, value - avg(value) OVER (PARTITION BY region) AS x, row_number() OVER (PARTITION BY region ORDER BY month) AS k, count(*) OVER (PARTITION BY region) AS n FROM filled",
)
_ACF = (
    "acf",
    """SELECT a.region, l.lag::INT AS lag, coalesce(sum(a.x * b.x), 0) / any_value(v.v) AS acf FROM centred a CROSS JOIN range(0, 60) l(lag)
    LEFT JOIN centred b ON a.region = b.region AND b.k = a.k - l.lag
    JOIN (SELECT region, sum(x * x) AS v FROM centred GROUP BY region) v ON v.region = a.region
    WHERE l.lag <= least(floor(10 * log10(a.n)), a.n - 1) GROUP BY a.region, l.lag""",
)


@query("t5_acf", with_sql(f"SELECT region, lag, {r('acf')} FROM acf", [FILLED, _CENTRED, _ACF]))
def t5(spark, sf):
    return rounded(series.acf(filled_series(spark, sf), KEY))


@query(
    "t6_pacf",
    with_sql(
        f"SELECT region, k::INT AS lag, {r('phi[k]', 6, 'pacf')} FROM dl WHERE k > 0",
        [
            FILLED,
            _CENTRED,
            _ACF,
            ("rho", "SELECT region, list(acf ORDER BY lag) FILTER (WHERE lag > 0) AS rho, max(lag) AS top FROM acf GROUP BY region"),
            (
                "dl",
                """SELECT region, rho, top, 0::BIGINT AS k, []::DOUBLE[] AS phi FROM rho UNION ALL
                SELECT region, rho, top, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - nw * phi[k + 1 - j]), [nw]) FROM (
                SELECT *, (rho[k + 1] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rho[k + 1 - j])), 0))
                / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rho[j])), 0)) AS nw FROM dl WHERE k < top)""",
            ),
        ],
        recursive=True,
    ),
)
def t6(spark, sf):
    return rounded(series.pacf(filled_series(spark, sf), KEY))


_CCF = (
    "two",
    "SELECT region, hum_cases - avg(hum_cases) OVER (PARTITION BY region) AS x, catt_cases - avg(catt_cases) OVER (PARTITION BY region) AS y, row_number() OVER (PARTITION BY region ORDER BY month) AS k FROM regional_counts",
)


@query(
    "t7_ccf",
    with_sql(
        f"""SELECT a.region, l.lag::INT AS lag, {r('coalesce(sum(a.x * b.y), 0) / any_value(s.s)', 6, 'ccf')} FROM two b CROSS JOIN range(-12, 13) l(lag)
        JOIN two a ON a.region = b.region AND a.k = b.k + l.lag
        JOIN (SELECT region, sqrt(sum(x * x) * sum(y * y)) AS s FROM two GROUP BY region) s ON s.region = b.region GROUP BY a.region, l.lag""",
        [_CCF],
    ),
)
def t7(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], ["hum_cases", "catt_cases"])
    return rounded(series.ccf(monthly, KEY, "hum_cases", "catt_cases", 12))


@query(
    "t8_adf_statistic",
    with_sql(
        f"SELECT region, n AS n_used, k, {r('b1', 6, 'gamma')}, {r('statistic')}, {r('p', 6, 'p_value')}, -3.96::DOUBLE AS crit_1, -3.41::DOUBLE AS crit_5, -3.12::DOUBLE AS crit_10 FROM tested",
        [
            FILLED,
            (
                "d",
                f"SELECT region, month, value - lag(value) OVER w AS dy, lag(value) OVER w AS lev, (row_number() OVER w - 1)::DOUBLE AS t, floor(pow(count(*) OVER (PARTITION BY region) - 1, 1 / 3.0::DOUBLE) + 1e-9)::INT AS k FROM filled WINDOW w AS {W}",
            ),
            (
                "dd",
                "SELECT *, " + ", ".join(f"CASE WHEN {j} <= k THEN lag(dy, {j}) OVER w ELSE 0 END AS d{j}" for j in range(1, 7)) + f" FROM d WINDOW w AS {W}",
            ),
            ("ok_rows", "SELECT * FROM dd WHERE t > k"),
            *ols_sql("adf", "ok_rows", KEY, "dy", ["lev", "t", *[f"d{j}" for j in range(1, 7)]]),
            ("tabled", "SELECT * FROM (VALUES " + ", ".join(f"({n}, {p}::DOUBLE, {row[i]}::DOUBLE)" for p, row in series.ADF_TABLE.items() for i, n in enumerate(series.ADF_SIZES)) + ") AS v(size, p, cut)"),
            ("spans", "SELECT p, size, cut, lead(size) OVER w AS size2, lead(cut) OVER w AS cut2 FROM tabled WINDOW w AS (PARTITION BY p ORDER BY size)"),
            ("sized", "SELECT region, b1 / se1 AS statistic, b1, n, k, least(greatest(changes, 25), 100000) AS size FROM adf_fit JOIN (SELECT region, any_value(k) AS k, count(*) - 1 AS changes FROM dd GROUP BY region) USING (region)"),
            # the line between the two sizes around, then between the two probabilities around
            ("cuts", "SELECT z.region, s.p, s.cut + (s.cut2 - s.cut) * (z.size - s.size) / (s.size2 - s.size) AS cut FROM sized z JOIN spans s ON z.size >= s.size AND (z.size < s.size2 OR (z.size = 100000 AND s.size2 = 100000))"),
            ("steps", "SELECT region, p, cut, lead(p) OVER w AS p2, lead(cut) OVER w AS cut2 FROM cuts WINDOW w AS (PARTITION BY region ORDER BY p)"),
            ("tested", "SELECT z.*, coalesce(CASE WHEN statistic <= (SELECT min(cut) FROM cuts c WHERE c.region = z.region) THEN 0.01 END, s.p + (s.p2 - s.p) * (statistic - s.cut) / (s.cut2 - s.cut), 0.99)::DOUBLE AS p FROM sized z LEFT JOIN steps s ON s.region = z.region AND statistic > s.cut AND statistic <= s.cut2"),
        ],
    ),
)
def t8(spark, sf):
    return rounded(series.adf(filled_series(spark, sf), KEY))


# ---------------------------------------------------------------- forecasts


def _ar_blocks(train: str, test: str, keys: list[str], d: int = 0) -> list[tuple[str, str]]:
    """Order choice, recursion and interval spreads of the AR(0..2) family in SQL; ends in ``path``."""
    k = ", ".join(keys)
    part = f"(PARTITION BY {k} ORDER BY month)"
    on = f"USING ({k})"
    value = "y - lag(y) OVER w" if d else "y"
    blocks = [
        ("base", f"SELECT {k}, month, y AS lev, {value} AS v FROM {train} WHERE y IS NOT NULL WINDOW w AS {part}"),
        ("lagged", f"SELECT *, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2 FROM base WINDOW w AS {part}"),
        ("used", "SELECT * FROM lagged WHERE l1 IS NOT NULL AND l2 IS NOT NULL"),
    ]
    for p in range(3):
        blocks += ols_sql(f"f{p}", "used", keys, "v", ["l1", "l2"][:p])
    aic = [
        f"f{p}.n * ln(greatest(f{p}.sse, f{p}.sst * 1e-15) / f{p}.n) + 2 * ({p} + 2)" for p in range(3)
    ]
    blocks.append(
        (
            "chosen",
            f"SELECT f0.{', f0.'.join(keys)}, f0.n, CASE WHEN a0 <= a1 AND a0 <= a2 THEN 0 WHEN a1 <= a2 THEN 1 ELSE 2 END AS p FROM f0_fit f0 JOIN (SELECT f0.{', f0.'.join(keys)}, {', '.join(f'{a} AS a{i}' for i, a in enumerate(aic))} "
            f"FROM f0_fit f0 JOIN f1_fit f1 {on} JOIN f2_fit f2 {on}) {on}",
        )
    )
    pick = lambda cells: "CASE p WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END".format(*cells)
    blocks.append(
        (
            "model",
            f"SELECT {k}, f0.n, p, {pick([f'f{i}.b0' for i in range(3)])} AS c, "
            f"{pick(['0', 'f1.b1', 'f2.b1'])} AS phi1, {pick(['0', '0', 'f2.b2'])} AS phi2, "
            f"{pick([f'f{i}.sse' for i in range(3)])} / (f0.n - p - 1) AS s2, {pick(['a0', 'a1', 'a2'])} AS aic "
            f"FROM f0_fit f0 JOIN f1_fit f1 {on} JOIN f2_fit f2 {on} JOIN chosen {on} JOIN (SELECT {', '.join(f'f0.{c}' for c in keys)}, {', '.join(f'{a} AS a{i}' for i, a in enumerate(aic))} "
            f"FROM f0_fit f0 JOIN f1_fit f1 {on} JOIN f2_fit f2 {on}) {on}",
        )
    )
    blocks.append(
        ("last", f"SELECT {k}, max(month) AS last_month, arg_max(v, month) AS y1, arg_max(l1, month) AS y2, arg_max(lev, month) AS lev FROM used GROUP BY {k}")
    )
    blocks.append(
        ("ahead", f"SELECT {k}, month, row_number() OVER {part} AS step FROM {test}")
    )
    new = "m.c + m.phi1 * y1 + m.phi2 * y2"
    psi = "m.phi1 * q1 + m.phi2 * q2"
    kk = ", ".join(f"z.{c}" for c in keys)
    blocks.append(
        (
            "path",
            f"SELECT {k}, NULL::DATE AS month, 0::BIGINT AS step, y1, y2, lev, 1.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, 1.0::DOUBLE AS wgt, 1.0::DOUBLE AS nxt, NULL::DOUBLE AS point, NULL::DOUBLE AS spread FROM last "
            f"UNION ALL SELECT {kk}, a.month, z.step + 1, {new}, y1, {'lev + ' if d else ''}{new}, {psi}, q1, "
            + (f"wgt + {psi}, nxt + (wgt + {psi}) * (wgt + {psi})" if d else f"{psi}, nxt + ({psi}) * ({psi})")
            + f", {'lev + ' if d else ''}{new}, nxt FROM path z JOIN model m {on} JOIN ahead a ON {' AND '.join(f'a.{c} = z.{c}' for c in keys)} AND a.step = z.step + 1",
        )
    )
    return blocks


ERROR_PASSES = 100


def _ar_error_blocks(train: str, test: str, keys: list[str], xreg: bool = True) -> list[tuple[str, str]]:
    """Regression with AR(0..2) errors by exact likelihood in SQL; ends in ``path`` with the names of ``_ar_blocks``.

    The sums of products are taken over pairs of months, and the partial autocorrelations found by halving an interval.
    """
    k = ", ".join(keys)
    part = f"(PARTITION BY {k} ORDER BY month)"
    on = f"USING ({k})"
    whole = f"(PARTITION BY {k})"
    x = "x" if xreg else "0.0::DOUBLE"
    lag = {("y", h): f"y{h}" for h in range(3)} | {("x", h): f"x{h}" for h in range(3)} | {("o", h): "1.0::DOUBLE" for h in range(3)}
    cell = lambda a, b, i, j: f"d{a}{b}{i}{j}" if i <= j else f"d{b}{a}{j}{i}"
    sums = ", ".join(
        f"coalesce(sum({lag[a, j - i]} * {lag[b, 0]}) FILTER (t BETWEEN {j + 1} AND n - {i}), 0)::DOUBLE AS {cell(a, b, i, j)}"
        for a in "yxo" for b in "yxo" for i in range(3) for j in range(i, 3)
    )
    blocks = [
        ("base", f"SELECT {k}, month, y, {x} AS x FROM {train} WHERE y IS NOT NULL{' AND x IS NOT NULL' if xreg else ''}"),
        ("centred", f"SELECT *, y - avg(y) OVER {whole} AS y0, x - avg(x) OVER {whole} AS x0, row_number() OVER {part} AS t, count(*) OVER {whole} AS n FROM base"),
        ("shifted", "SELECT *, " + ", ".join(f"lag({v}0, {h}) OVER w AS {v}{h}" for v in "yx" for h in (1, 2)) + f" FROM centred WINDOW w AS {part}"),
        ("products", f"SELECT {k}, any_value(n)::DOUBLE AS n, avg(y) AS my, avg(x) AS mx, {sums} FROM shifted GROUP BY {k}"),
    ]
    g = ["1.0::DOUBLE", "g1", "g2"]
    q = lambda a, b: " + ".join(f"{g[i]} * {g[j]} * {cell(a, b, i, j)}" for i in range(3) for j in range(3))
    forms = ", ".join(f"{q(a, b)} AS q{a}{b}" for a, b in ("oo", "ox", "xx", "oy", "xy"))
    u = lambda i, j: (
        f"{cell('y', 'y', i, j)} - c * ({cell('y', 'o', i, j)} + {cell('o', 'y', i, j)}) - beta * ({cell('y', 'x', i, j)} + {cell('x', 'y', i, j)})"
        f" + c * c * {cell('o', 'o', i, j)} + c * beta * ({cell('o', 'x', i, j)} + {cell('x', 'o', i, j)}) + beta * beta * {cell('x', 'x', i, j)}"
    )
    us = ", ".join(f"{u(i, j)} AS u{i}{j}" for i in range(3) for j in range(i, 3))
    halves = ", ".join(["-1.0::DOUBLE", *[repr(2.0**-i) + "::DOUBLE" for i in range(56)]])

    def root(a: str, b: str, c: str, j: int) -> str:
        at = "(lo + s)"
        f = f"n * (({a}) * {at} - ({b})) * (1 - {at} * {at}) + {j} * {at} * (({a}) * {at} * {at} - 2 * ({b}) * {at} + ({c}))"
        return f"list_reduce([{halves}], lambda lo, s: CASE WHEN {f} < 0 THEN lo + s ELSE lo END)"

    first = root("(1 - r2) * (1 - r2) * u11", "(1 - r2) * (u01 - r2 * u12)", "u00 - 2 * r2 * u02 + r2 * r2 * u22", 1)
    second = root("r1 * r1 * u11 - 2 * r1 * u12 + u22", "r1 * r1 * u11 - r1 * u12 - r1 * u01 + u02", "u00 - 2 * r1 * u01 + r1 * r1 * u11", 2)
    slope = f"SELECT *, {'CASE WHEN qoo * qxx - qox * qox > 1e-12 * qoo * qxx THEN (qoo * qxy - qox * qoy) / (qoo * qxx - qox * qox) ELSE 0 END' if xreg else '0.0::DOUBLE'} AS beta"
    kz = ", ".join(f"z.{c}" for c in keys)
    blocks.append(
        (
            "passes",
            f"SELECT {k}, p, 0 AS it, 0.0::DOUBLE AS r1, 0.0::DOUBLE AS r2, 0.0::DOUBLE AS c, 0.0::DOUBLE AS beta FROM products CROSS JOIN range(0, 3) o(p) "
            f"UNION ALL SELECT {k}, p, it + 1, r1, CASE WHEN p > 1 THEN {second} ELSE 0 END, c, beta FROM ("
            f"SELECT * EXCLUDE (r1), CASE WHEN p > 0 THEN {first} ELSE 0 END AS r1 FROM (SELECT *, {us} FROM ("
            f"SELECT *, (qoy - beta * qox) / qoo AS c FROM ({slope} FROM (SELECT *, {forms} FROM ("
            f"SELECT {kz}, z.p, z.it, z.r1, z.r2, -z.r1 * (1 - z.r2) AS g1, -z.r2 AS g2, m.* EXCLUDE ({k}) "
            f"FROM passes z JOIN products m {on} WHERE z.it < {ERROR_PASSES}"
            "))))))",
        )
    )
    size = 2 if xreg else 1
    blocks += [
        (
            "candidates",
            f"SELECT *, greatest(u00 + g1 * g1 * u11 + g2 * g2 * u22 + 2 * (g1 * u01 + g2 * u02 + g1 * g2 * u12), 0) AS sse FROM (SELECT *, {us} FROM ("
            f"SELECT *, -r1 * (1 - r2) AS g1, -r2 AS g2 FROM passes JOIN products {on} WHERE it = {ERROR_PASSES} AND n > p + {size} AND n > 2 * p + 1))",
        ),
        (
            "model",
            f"SELECT {k}, n, p, (c + my - beta * mx) * (1 + g1 + g2) AS c, -g1 AS phi1, -g2 AS phi2, beta, sse / (n - p - {size}) AS s2, aic FROM ("
            f"SELECT *, n * ln(greatest(sse, dyy00 * 1e-15) / n) - ln(1 - r1 * r1) - 2 * ln(1 - r2 * r2) + 2 * (p + {size + 1}) AS aic FROM candidates) "
            f"QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY aic, p) = 1",
        ),
        ("level", f"SELECT {k}, month, y - beta * x AS v, lag(y - beta * x) OVER {part} AS w FROM base JOIN model {on}"),
        ("last", f"SELECT {k}, arg_max(v, month) AS y1, arg_max(w, month) AS y2 FROM level GROUP BY {k}"),
        ("ahead", f"SELECT {k}, month, {x} AS x, row_number() OVER {part} AS step FROM {test}"),
        (
            "path",
            f"SELECT {k}, NULL::DATE AS month, 0::BIGINT AS step, y1, y2, 1.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, 1.0::DOUBLE AS nxt, NULL::DOUBLE AS point, NULL::DOUBLE AS spread FROM last "
            f"UNION ALL SELECT {kz}, a.month, z.step + 1, m.c + m.phi1 * y1 + m.phi2 * y2, y1, m.phi1 * q1 + m.phi2 * q2, q1, nxt + (m.phi1 * q1 + m.phi2 * q2) * (m.phi1 * q1 + m.phi2 * q2), "
            f"m.c + m.phi1 * y1 + m.phi2 * y2 + m.beta * a.x, nxt FROM path z JOIN model m {on} JOIN ahead a ON {' AND '.join(f'a.{c} = z.{c}' for c in keys)} AND a.step = z.step + 1",
        ),
    ]
    return blocks


def _limits() -> str:
    cells = []
    for name, sign, z in (
        ("lower_80", "-", 1.2815515655446004),
        ("upper_80", "+", 1.2815515655446004),
        ("lower_95", "-", 1.959963984540054),
        ("upper_95", "+", 1.959963984540054),
    ):
        cells.append(r(f"point {sign} {z}::DOUBLE * sqrt(s2 * spread)", 6, name))
    return ", ".join(cells)


_SPLIT = [
    FILLED,
    (
        "parts",
        "SELECT *, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM (SELECT region, month, value AS y, row_number() OVER (PARTITION BY region ORDER BY month) AS k, count(*) OVER (PARTITION BY region) AS n FROM filled)",
    ),
    ("train_part", "SELECT region, month, y FROM parts WHERE part = 'train'"),
    ("test_part", "SELECT region, month, y FROM parts WHERE part = 'test'"),
]
_PLAIN = [*_SPLIT, *_ar_blocks("train_part", "test_part", KEY)]
_PLAIN_FC = "SELECT p.region, p.month, p.step::INT AS step, round_even(p.point, 3) AS forecast, p.point, t.y AS actual, m.s2, p.spread FROM path p JOIN test_part t ON t.region = p.region AND t.month = p.month JOIN model m ON m.region = p.region WHERE p.step > 0"


def _parts(spark, sf):
    """Train and test months, written once: both forecasts and their models read them."""
    return materialise(rows.holdout(filled_series(spark, sf), KEY, "month"), "holdout")


@query(
    "t9_ar_forecast",
    with_sql(
        f"SELECT region, month, step, forecast + 0.0::DOUBLE AS forecast, {_limits()}, {r('actual')} FROM ({_PLAIN_FC})",
        _PLAIN,
        recursive=True,
    ),
)
def t9(spark, sf):
    return rounded(fc.ar_forecast(_parts(spark, sf), KEY, "month", "value", MAX_P))


ARMA_PASSES = 40


def _arma_blocks(train: str, test: str) -> list[tuple[str, str]]:
    """ARMA(0..2, 0..1) by conditional least squares in SQL; ends in ``path``.

    One recursion runs over months and passes: a row is a series and order at one month of one pass, with the residual, its
    derivatives and the sums so far; behind the last month the sums give the next step.
    """
    names = ["c", "f1", "f2", "m1"]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    cell = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    sums = [cell(i, j) for i, j in pairs] + [f"r{i}" for i in range(4)]
    carried = "region, p, q, n"
    start = ", ".join(["0.0::DOUBLE AS " + x for x in ["e1", *[f"g{i}" for i in range(4)], "sse", *sums]])
    # a month: residual and derivatives from those of the month before
    month = (
        f"SELECT {carried}, it, t + 1 AS t, {', '.join(f'b_{x}, d_{x}, k_{x}' for x in names)}, least_sse, scale, e AS e1, {', '.join(f'h{i} AS g{i}' for i in range(4))}, sse + e * e AS sse, "
        + ", ".join(f"s{i}{j} + h{i} * h{j} AS s{i}{j}" for i, j in pairs)
        + ", "
        + ", ".join(f"r{i} + h{i} * e AS r{i}" for i in range(4))
        + " FROM (SELECT z.*, y.y - k_c - k_f1 * y.l1 - k_f2 * y.l2 - k_m1 * e1 AS e, -1 - k_m1 * g0 AS h0, CASE WHEN p > 0 THEN -y.l1 - k_m1 * g1 ELSE 0 END AS h1, "
        "CASE WHEN p > 1 THEN -y.l2 - k_m1 * g2 ELSE 0 END AS h2, CASE WHEN q > 0 THEN -e1 - k_m1 * g3 ELSE 0 END AS h3 FROM run z JOIN months y ON y.region = z.region AND y.t = z.t WHERE z.t <= z.n)"
    )
    # the end of a pass: keep or halve, then solve by sweeping the parameters that the order has
    swept = f"SELECT *, sse <= least_sse * (1 + 1e-9::DOUBLE) AS better, it = 0 OR (abs(k_m1) > 0.98::DOUBLE * (1 - 1e-12::DOUBLE) AND -r3 * k_m1 > 0) AS still FROM run WHERE t > n AND it < {ARMA_PASSES}"
    has = ["true", "p > 0", "p > 1", "q > 0 AND NOT still"]
    keep = f"{carried}, it, better, still, {', '.join(f'b_{x}, d_{x}, k_{x}' for x in names)}, least_sse, scale, sse"
    for s in range(4):
        ok = f"({has[s]} AND abs({cell(s, s)}) > 0)"
        out = []
        cols = [*pairs, *[(i, 4) for i in range(4)]]
        at = lambda i, j: f"r{i}" if j == 4 else cell(i, j)
        for i, j in cols:
            if i == s and j == s:
                new = f"-1.0::DOUBLE / {at(s, s)}"
            elif i == s or j == s:
                new = f"{at(j if i == s else i, s) if j != 4 else at(s, 4)} / {at(s, s)}"
            else:
                right = at(s, 4) if j == 4 else cell(j, s)
                new = f"{at(i, j)} - {cell(i, s)} * {right} / {at(s, s)}"
            out.append(f"CASE WHEN {ok} THEN {new} ELSE {at(i, j)} END AS {at(i, j)}")
        swept = f"SELECT {keep}, {', '.join(out)} FROM ({swept})"
    moved = ", ".join(f"CASE WHEN better THEN k_{x} ELSE b_{x} END AS b_{x}, CASE WHEN better THEN CASE WHEN {h} THEN -r{i} ELSE 0 END ELSE d_{x} END AS d_{x}" for i, (x, h) in enumerate(zip(names, has)))
    ended = f"SELECT {carried}, it + 1 AS it, {moved}, CASE WHEN better THEN sse ELSE least_sse END AS least_sse, CASE WHEN better THEN 1 ELSE scale / 2 END AS scale FROM ({swept})"
    again = f"SELECT {carried}, it, 3 AS t, {', '.join(f'b_{x}, d_{x}, {"least(greatest(b_m1 + scale * d_m1, -0.98::DOUBLE), 0.98::DOUBLE)" if x == "m1" else f"b_{x} + scale * d_{x}"} AS k_{x}' for x in names)}, least_sse, scale, {start} FROM ({ended})"
    first = ", ".join(f"{v} AS b_{x}, 0.0::DOUBLE AS d_{x}, {v} AS k_{x}" for x, v in zip(names, ["mean", *["0.0::DOUBLE"] * 3]))
    on = "USING (region)"
    return [
        ("scaled", f"SELECT region, month, avg(y) OVER w AS mean, coalesce(nullif(stddev_pop(y) OVER w, 0), 1) AS dev, (y - avg(y) OVER w) / coalesce(nullif(stddev_pop(y) OVER w, 0), 1) AS y, count(*) OVER w AS n FROM {train} WHERE y IS NOT NULL WINDOW w AS (PARTITION BY region)"),
        ("months", "SELECT *, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, row_number() OVER w AS t FROM scaled WINDOW w AS (PARTITION BY region ORDER BY month)"),
        ("orders_tried", "SELECT region, p::INT AS p, q::INT AS q, any_value(n) AS n, avg(y) FILTER (t > 2) AS mean FROM months CROSS JOIN range(0, 3) a(p) CROSS JOIN range(0, 2) b(q) GROUP BY region, p, q"),
        ("run", f"SELECT {carried}, 0 AS it, 3::BIGINT AS t, {first}, 'Infinity'::DOUBLE AS least_sse, 1.0::DOUBLE AS scale, {start} FROM orders_tried UNION ALL ({month} UNION ALL {again})"),
        ("fits", f"SELECT *, (n - 2) * ln(least_sse / (n - 2)) + 2 * (p + q + 2) AS aic FROM run WHERE it = {ARMA_PASSES} AND t = 3"),
        ("model", "SELECT region, p, q, b_c AS c, b_f1 AS phi1, b_f2 AS phi2, b_m1 AS theta, least_sse / (n - 3 - p - q) AS s2 FROM fits QUALIFY row_number() OVER (PARTITION BY region ORDER BY aic, p, q) = 1"),
        ("tail", "SELECT m.region, y.t, y.n, y.y - c - phi1 * l1 - phi2 * l2 AS e, y.y, y.l1, theta FROM months y JOIN model m USING (region) WHERE t > 2"),
        ("shock", "SELECT region, 3::BIGINT AS t, e FROM tail WHERE t = 3 UNION ALL SELECT x.region, x.t, x.e - x.theta * z.e FROM shock z JOIN tail x ON x.region = z.region AND x.t = z.t + 1"),
        ("last", f"SELECT region, x.y AS y1, x.l1 AS y2, z.e AS e1 FROM shock z JOIN tail x USING (region, t) WHERE x.t = x.n"),
        ("ahead", f"SELECT region, month, row_number() OVER (PARTITION BY region ORDER BY month) AS step FROM {test}"),
        (
            "scaled_path",
            "SELECT region, NULL::DATE AS month, 0::BIGINT AS step, y1, y2, e1, 1.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, 1.0::DOUBLE AS nxt, NULL::DOUBLE AS point, NULL::DOUBLE AS spread FROM last "
            "UNION ALL SELECT region, month, step, v, y1, 0, w, q1, nxt + w * w, v, nxt FROM (SELECT z.region, a.month, a.step, m.c + m.phi1 * y1 + m.phi2 * y2 + m.theta * e1 AS v, y1, "
            f"m.phi1 * q1 + m.phi2 * q2 + CASE WHEN a.step = 1 THEN m.theta ELSE 0 END AS w, q1, nxt FROM scaled_path z JOIN model m {on} JOIN ahead a ON a.region = z.region AND a.step = z.step + 1)",
        ),
        ("path", "SELECT p.region, month, step, point * dev + mean AS point, spread * dev * dev AS spread FROM scaled_path p JOIN (SELECT DISTINCT region, mean, dev FROM scaled) USING (region)"),
    ]


@query(
    "t9_arma_forecast",
    with_sql(
        f"SELECT region, p, q, month, step, forecast + 0.0::DOUBLE AS forecast, {_limits()}, {r('actual')} FROM (SELECT p.region, m.p, m.q, p.month, p.step::INT AS step, round_even(p.point, 3) AS forecast, p.point, t.y AS actual, m.s2, p.spread FROM path p JOIN test_part t ON t.region = p.region AND t.month = p.month JOIN model m ON m.region = p.region WHERE p.step > 0)",
        [*_SPLIT, *_arma_blocks("train_part", "test_part")],
        recursive=True,
    ),
)
def t9_arma(spark, sf):
    parts = _parts(spark, sf)
    models = fc.fit_arma(parts.where("part = 'train'"), KEY, max_p=MAX_P, max_q=1, passes=ARMA_PASSES).select("region", "p", "q")
    paths = fc.arma_forecast(parts, KEY, "month", "value", MAX_P, 1, passes=ARMA_PASSES)
    return rounded(joins.join_same(paths, models, KEY))


_X_KEYS = ["region", "lag"]
_X_SPLIT = [
    (
        "numbered",
        "SELECT region, month, hum_cases::DOUBLE AS y, (catt_cases + goat_cases + shp_cases)::DOUBLE AS x0, row_number() OVER (PARTITION BY region ORDER BY month) AS k, count(*) OVER (PARTITION BY region) AS n FROM regional_counts",
    ),
    (
        "parts",
        "SELECT a.region, l.lag::INT AS lag, a.month, a.y, b.x0 AS x, CASE WHEN a.k <= floor(a.n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM numbered a CROSS JOIN range(0, 7) l(lag) LEFT JOIN numbered b ON b.region = a.region AND b.k = a.k - l.lag",
    ),
    ("train_part", "SELECT region, lag, month, y, x FROM parts WHERE part = 'train'"),
    ("test_part", "SELECT region, lag, month, y, x FROM parts WHERE part = 'test'"),
]
_ARX = [*_X_SPLIT, *_ar_error_blocks("train_part", "test_part", _X_KEYS)]
_ARX_FC = "SELECT p.region, p.lag, p.month, p.step::INT AS step, round_even(p.point, 3) AS forecast, p.point, t.y AS actual, m.s2, p.spread FROM path p JOIN test_part t ON t.region = p.region AND t.lag = p.lag AND t.month = p.month JOIN model m ON m.region = p.region AND m.lag = p.lag WHERE p.step > 0"


def _x_parts(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], rollup.CASES)
    pair = monthly.select(
        "region",
        "month",
        F.col("hum_cases").cast("double").alias("y"),
        (F.col("catt_cases") + F.col("goat_cases") + F.col("shp_cases")).cast("double").alias("x"),
    )
    return materialise(rows.holdout(pair, KEY, "month"), "holdout")


@query(
    "t10_arx_forecast",
    with_sql(
        f"SELECT region, lag, month, step, forecast + 0.0::DOUBLE AS forecast, {_limits()}, {r('actual')} FROM ({_ARX_FC})",
        _ARX,
        recursive=True,
    ),
)
def t10(spark, sf):
    return rounded(fc.arx_forecast(_x_parts(spark, sf), KEY, "month", "y", "x", max_p=MAX_P))


@query(
    "t11_prediction_intervals",
    with_sql(
        f"SELECT p.region, p.month, p.step::INT AS step, {r('point', 6, 'forecast')}, {_limits()} FROM path p JOIN model m ON m.region = p.region WHERE p.step > 0",
        [
            FILLED,
            ("train_part", "SELECT region, month, value AS y FROM filled"),
            (
                "test_part",
                "SELECT region, (max(month) + INTERVAL 1 MONTH * s.i)::DATE AS month FROM filled, range(1, 13) s(i) GROUP BY region, s.i",
            ),
            *_ar_blocks("train_part", "test_part", KEY, d=1),
        ],
        recursive=True,
    ),
)
def t11(spark, sf):
    models = fc.fit_ar(filled_series(spark, sf), KEY, max_p=MAX_P, d=1)
    return rounded(fc.forecast(models, KEY, MAX_P, horizon=12, d=1))


_FITTED = "SELECT region, month, lagged.v AS y, c + phi1 * l1 + phi2 * l2 AS fitted FROM lagged JOIN model USING (region)"


@query(
    "t12_fitted_values",
    with_sql(
        f"SELECT region, month, {r('y', 6, 'value')}, {r('fitted')}, {r('y - fitted', 6, 'residual')} FROM ({_FITTED})",
        _PLAIN,
        recursive=True,
    ),
)
def t12(spark, sf):
    return rounded(_train_residuals(spark, sf))


def _train_residuals(spark, sf):
    train = _parts(spark, sf).where(F.col("part") == "train").select("region", "month", "value")
    models = fc.fit_ar(train, KEY, max_p=MAX_P)
    return fc.fitted_values(train, models, KEY, MAX_P)


def _acc(actual: str = "actual", fitted: str = "forecast") -> str:
    # means of forecasts with 3 decimals can end in a 5 in the seventh decimal, which 8 digits don't cut
    e = f"({actual} - {fitted})"
    return ", ".join(
        [
            r(f"avg(abs({e}))", 8, "mae"),
            r(f"sqrt(avg({e} * {e}))", 8, "rmse"),
            r(f"avg(abs({e} / nullif({actual}, 0))) * 100", 8, "mape"),
        ]
    )


@query(
    "t13_forecast_accuracy",
    with_sql(f"SELECT region, lag, {_acc()} FROM ({_ARX_FC}) GROUP BY region, lag", _ARX, recursive=True),
)
def t13(spark, sf):
    paths = fc.arx_forecast(_x_parts(spark, sf), KEY, "month", "y", "x", max_p=MAX_P)
    return rounded(regression.accuracy(paths, "actual", "forecast", ["region", "lag"]), digits=8)


def _comparison_sql() -> str:
    x = [(n, b) for n, b in _ARX]
    plain = []
    rename = {"train_part": "train_p", "test_part": "test_p"}
    for name, body in _ar_error_blocks("train_p", "test_p", KEY, xreg=False):
        rename[name] = f"p_{name}"
        plain.append((name, body))
    import re

    def sub(text: str) -> str:
        return re.sub(r"\b(" + "|".join(sorted(rename, key=len, reverse=True)) + r")\b", lambda m: rename[m.group(1)], text)

    # block names of the plain family get a prefix
    prefixed = [(sub(n), sub(b)) for n, b in plain]
    extra = [
        ("train_p", "SELECT DISTINCT region, month, y FROM parts WHERE part = 'train' AND lag = 0"),
        ("test_p", "SELECT DISTINCT region, month, y FROM parts WHERE part = 'test' AND lag = 0"),
    ]
    plain_fc = sub(_PLAIN_FC)
    return with_sql(
        f"SELECT region, 'Model with no exogenous variable' AS model, {_acc()} FROM ({plain_fc}) GROUP BY region UNION ALL "
        f"SELECT region, 'Model with exogenous variable' AS model, {_acc()} FROM ({_ARX_FC}) WHERE lag = 1 GROUP BY region",
        [*x, *extra, *prefixed],
        recursive=True,
    )


@query("t14_model_comparison", _comparison_sql())
def t14(spark, sf):
    parts = _x_parts(spark, sf)
    plain = fc.ar_forecast(parts, KEY, "month", "y", MAX_P, exact=True)
    with_x = fc.arx_forecast(parts, KEY, "month", "y", "x", lags=[1], max_p=MAX_P)
    return rounded(fc.model_comparison(plain, with_x, KEY), digits=8)


_RES = ("res", f"SELECT region, month, y - fitted AS residual FROM ({_FITTED}) WHERE fitted IS NOT NULL")


@query(
    "t15_residual_histogram",
    with_sql(
        f"SELECT region, n_bins, bin, {r('lo + (bin - 1) * (hi - lo) / n_bins', 6, 'low')}, {r('lo + bin * (hi - lo) / n_bins', 6, 'high')}, count(*) AS count FROM ("
        "SELECT region, n_bins, lo, hi, least(floor((residual - lo) / (hi - lo) * n_bins) + 1, n_bins)::BIGINT AS bin FROM res JOIN st USING (region)) GROUP BY region, n_bins, lo, hi, bin",
        [
            *_PLAIN,
            _RES,
            (
                "st",
                "SELECT region, min(residual) AS lo, max(residual) AS hi, greatest(least(ceil((max(residual) - min(residual)) / (2 * (quantile_cont(residual, 0.75) - quantile_cont(residual, 0.25)) / pow(count(*), 1 / 3.0::DOUBLE))), 500), 1)::BIGINT AS n_bins FROM res GROUP BY region",
            ),
        ],
        recursive=True,
    ),
)
def t15_histogram(spark, sf):
    residuals = _train_residuals(spark, sf).where(F.col("residual").isNotNull())
    return rounded(fc.residual_histogram(residuals, KEY))


@query(
    "t15_residual_acf",
    with_sql(
        f"SELECT region, lag, {r('acf')} FROM acf",
        [*_PLAIN, ("res", _RES[1]), (_CENTRED[0], _CENTRED[1].replace("value", "residual").replace("FROM filled", "FROM res")), _ACF],
        recursive=True,
    ),
)
def t15_acf(spark, sf):
    return rounded(series.acf(_train_residuals(spark, sf).select("region", "month", "residual"), KEY, value="residual"))


@query(
    "t15_residual_pairs",
    with_sql(
        f"SELECT region, month, {r('previous')}, {r('current')} FROM (SELECT region, month, lag(residual) OVER {W} AS previous, residual AS current FROM res) WHERE previous IS NOT NULL",
        [*_PLAIN, _RES],
        recursive=True,
    ),
)
def t15_pairs(spark, sf):
    return rounded(fc.residual_pairs(_train_residuals(spark, sf), KEY, "month"))
