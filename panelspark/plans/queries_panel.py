"""Queries of reshaping, joins, set operations, aggregates, windows, sorting and classes (R, J, E, A, W, O, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import vocab as V
from panelspark.operators import classify, joins, reshape, rollup, windows
from panelspark.plans import fixture as fx
from panelspark.plans import panels
from panelspark.plans.oracle import CASES, POP, POPS, RATE_EXPRS, ROUND_RATES, SERIES, SUM_CASES, r, with_sql
from panelspark.plans.registry import query, rounded


# ---------------------------------------------------------------- reshape


@query("r1_unpivot", with_sql(f"SELECT region, year, month, diagnosis, variable, value FROM (UNPIVOT (SELECT * FROM panel) ON {CASES} INTO NAME variable VALUE value)"))
def r1(spark, sf):
    return reshape.unpivot(fx.base_panel(spark, sf), ["region", "year", "month", "diagnosis"], rollup.CASES, "variable", "value")


def _diag() -> str:
    return ", ".join(
        f"sum(cases) FILTER (WHERE diagnosis = '{d}')::BIGINT AS {name}" for d, name in fx.STATUSES.items()
    )


@query("r2_pivot", with_sql(f"SELECT region, month, series, {_diag()} FROM long_cases GROUP BY region, month, series"))
def r2(spark, sf):
    return reshape.pivot(fx.long_cases(spark, sf), ["region", "month", "series"], "diagnosis", fx.STATUSES, "cases")


@query(
    "r3_pivot_filled",
    with_sql(
        "SELECT region, month, series, "
        + ", ".join(
            f"coalesce(sum(cases) FILTER (WHERE diagnosis = '{d}'), 0)::BIGINT AS {name}" for d, name in fx.STATUSES.items()
        )
        + " FROM long_cases GROUP BY region, month, series"
    ),
)
def r3(spark, sf):
    return reshape.pivot(fx.long_cases(spark, sf), ["region", "month", "series"], "diagnosis", fx.STATUSES, "cases", fill=0)


@query(
    "r4_pivot_multi",
    with_sql(
        "SELECT region, year, "
        + ", ".join(
            f"sum({c}) FILTER (WHERE diagnosis = '{d}')::BIGINT AS {c}_{d}" for c in ("hum_cases", "catt_cases") for d in "FOP"
        )
        + " FROM panel GROUP BY region, year"
    ),
)
def r4(spark, sf):
    yearly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "year", "diagnosis"], ["hum_cases", "catt_cases"])
    return reshape.pivot_multi(yearly, ["region", "year"], "diagnosis", list("FOP"), ["hum_cases", "catt_cases"])


@query("r5_year_spine", with_sql("SELECT region, catt_pop, y.year::INT AS year FROM regional_den, range(2014, 2023) y(year)"))
def r5(spark, sf):
    return reshape.year_spine(fx.regional_denominators(spark, sf).select("region", "catt_pop"), 2014, 2022)


# ---------------------------------------------------------------- joins and set operations


@query(
    "j1_join_inner",
    with_sql("SELECT p.region, p.year, month, diagnosis, hum_cases, pop FROM panel p JOIN den d ON p.region = d.region AND p.year = d.year"),
)
def j1(spark, sf):
    joined = joins.join_inner(fx.base_panel(spark, sf), fx.denominators(spark, sf), ["region", "year"])
    return joined.select("region", "year", "month", "diagnosis", "hum_cases", "pop")


@query(
    "j2_join_full_outer",
    with_sql(
        """SELECT coalesce(h.region, a.region) AS region, coalesce(h.month, a.month) AS month, coalesce(h.diagnosis, a.diagnosis) AS diagnosis,
        hum_cases, animal_cases FROM
        (SELECT region, month, diagnosis, sum(cases)::BIGINT AS hum_cases FROM long_cases WHERE series = '1-URGENT' GROUP BY ALL) h FULL JOIN
        (SELECT region, month, diagnosis, sum(cases)::BIGINT AS animal_cases FROM long_cases WHERE series <> '1-URGENT' GROUP BY ALL) a
        ON h.region = a.region AND h.month = a.month AND h.diagnosis = a.diagnosis"""
    ),
)
def j2(spark, sf):
    cases = fx.long_cases(spark, sf)
    keys = ["region", "month", "diagnosis"]
    human = cases.where(F.col("series") == "1-URGENT").groupBy(*keys).agg(F.sum("cases").alias("hum_cases"))
    animal = cases.where(F.col("series") != "1-URGENT").groupBy(*keys).agg(F.sum("cases").alias("animal_cases"))
    return joins.join_full(human, animal, keys)


@query(
    "j3_join_rolled_denominator",
    with_sql(f"SELECT c.year, month, {CASES}, {POPS} FROM national_counts c JOIN national_den d ON c.year = d.year"),
)
def j3(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["year", "month"], rollup.CASES)
    return joins.join_rolled_denominator(monthly, fx.denominators(spark, sf), ["year"], rollup.POPS)


@query(
    "j4_join_cross",
    with_sql(
        "SELECT region, month, hum_cases, "
        + r("mean_cases")
        + ", max_cases FROM regional_counts, (SELECT avg(hum_cases) AS mean_cases, max(hum_cases) AS max_cases FROM regional_counts)"
    ),
)
def j4(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], ["hum_cases"])
    aggs = {"mean_cases": F.avg("hum_cases"), "max_cases": F.max("hum_cases")}
    return rounded(joins.attach_scalars(monthly, monthly, aggs))


@query(
    "j5_join_region_names",
    with_sql(
        f"""SELECT replace(p.region, '_', '-') AS region, year, {SUM_CASES}, r_name FROM panel p JOIN nation n ON n.n_name = p.region
        JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ALL"""
    ),
)
def j5(spark, sf):
    names = (
        fx.table(spark, sf, "nation")
        .join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.regexp_replace("n_name", "_", "-").alias("map_name"), "r_name")
    )
    yearly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "year"], rollup.CASES)
    return joins.join_region_names(yearly, names, "region", F.regexp_replace("region", "_", "-"), "map_name")


@query(
    "e1_union_all",
    """SELECT source, key, count(*) AS n FROM (SELECT 'orders' AS source, o_orderstatus AS key FROM orders
    UNION ALL SELECT 'lineitem', l_linestatus FROM lineitem UNION ALL SELECT 'orders', o_orderstatus FROM orders) GROUP BY source, key""",
)
def e1(spark, sf):
    orders = fx.table(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_orderstatus").alias("key"))
    items = fx.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("key"), F.lit("lineitem").alias("source"))
    return joins.union_all(orders, items, orders).groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))


@query("e2_distinct", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def e2(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag").distinct()


@query(
    "e3_setdiff",
    "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5",
)
def e3(spark, sf):
    items = fx.table(spark, sf, "lineitem")
    return joins.setdiff(items.where(F.col("l_quantity") > 45), items.where(F.col("l_quantity") < 5), "l_partkey")


# ---------------------------------------------------------------- aggregates


@query("a1_sum_by", with_sql(f"SELECT region, year, diagnosis, {SUM_CASES} FROM panel GROUP BY region, year, diagnosis"))
def a1(spark, sf):
    return rollup.sum_by(fx.base_panel(spark, sf), ["region", "year", "diagnosis"], rollup.CASES)


def _rollup_sql() -> str:
    parts = []
    for name, keys in rollup.GRAINS.items():
        cols = ", ".join(
            k if k in keys else f"NULL::{'DATE' if k == 'month' else 'INT' if k == 'year' else 'VARCHAR'} AS {k}"
            for k in rollup.PANEL_KEYS
        )
        counts = f"SELECT {cols}, {SUM_CASES} FROM panel GROUP BY {', '.join('panel.' + k for k in keys)}"
        den, on = ("den", "c.region = d.region AND c.year = d.year") if "region" in keys else ("national_den", "c.year = d.year")
        parts.append(
            f"SELECT '{name}' AS grain, region, year, month, diagnosis, {CASES}, {POPS}, {ROUND_RATES} FROM (SELECT c.*, {POPS}, {RATE_EXPRS} FROM ({counts}) c JOIN {den} d ON {on}) c"
        )
    return with_sql(" UNION ALL ".join(parts))


@query("a2_panel_rollup", _rollup_sql())
def a2(spark, sf):
    return rounded(rollup.panel_rollup(fx.base_panel(spark, sf), fx.denominators(spark, sf)))


_YEARLY_RATES = f"SELECT region, year, variable, value FROM (UNPIVOT (SELECT region, year, {', '.join(f'coalesce(sum({s}_incidence), 0) AS {s}' for s in SERIES)} FROM rated GROUP BY region, year) ON {', '.join(SERIES)} INTO NAME variable VALUE value)"
_DESCRIBE = ", ".join(
    [r("avg(value)", 6, "mean"), r("min(value)", 6, "min"), r("median(value)", 6, "median"), r("max(value)", 6, "max"), r("stddev_samp(value)", 6, "sd")]
)


@query("a3_describe", with_sql(f"SELECT region, variable, {_DESCRIBE} FROM yr GROUP BY region, variable", [("yr", _YEARLY_RATES)]))
def a3(spark, sf):
    return rounded(rollup.incidence_summary(fx.rated_panel(spark, sf), ["region"]))


@query(
    "a4_share_of_total",
    with_sql(
        "SELECT region, series, diagnosis, cases::DOUBLE AS cases, total::DOUBLE AS total, "
        + r("cases / total::DOUBLE", 6, "share")
        + " FROM (SELECT region, series, diagnosis, sum(cases) AS cases, sum(sum(cases)) OVER (PARTITION BY region, series) AS total FROM long_cases GROUP BY region, series, diagnosis)"
    ),
)
def a4(spark, sf):
    return rounded(rollup.share_of_total(fx.long_cases(spark, sf), ["region", "series"], "diagnosis", "cases"))


@query(
    "a5_annual_average",
    with_sql(
        "SELECT region, series, sum(cases)::DOUBLE AS total, count(DISTINCT year) AS years, "
        + r("sum(cases)::DOUBLE / count(DISTINCT year)", 6, "average")
        + " FROM long_cases GROUP BY region, series"
    ),
)
def a5(spark, sf):
    return rounded(rollup.annual_average(fx.long_cases(spark, sf), ["region", "series"], "year", "cases"))


@query(
    "a6_first_by",
    "SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) WHERE k = 1",
)
def a6(spark, sf):
    order = F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rollup.first_by(fx.table(spark, sf, "lineitem"), ["l_partkey"], ["l_orderkey", "l_quantity"], order)


@query(
    "a7_mean_growth",
    with_sql(
        "SELECT region, round_even(avg((v - b) / nullif(b, 0) * 100), 2) AS growth_rate FROM (SELECT region, v, lag(v) OVER (PARTITION BY region ORDER BY year) AS b FROM (SELECT region, year, sum(hum_cases)::DOUBLE AS v FROM panel GROUP BY region, year)) GROUP BY region"
    ),
)
def a7(spark, sf):
    yearly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "year"], ["hum_cases"])
    return rollup.mean_growth(yearly, "region", "year", "hum_cases")


def _summary_sql() -> str:
    shares = ", ".join(
        f"coalesce(sum(value) FILTER (WHERE diagnosis = '{d}'), 0)::DOUBLE AS {stem}_cases, "
        + r(f"coalesce(coalesce(sum(value) FILTER (WHERE diagnosis = '{d}'), 0) / nullif(sum(value), 0)::DOUBLE, 0)", 6, f"{stem}_share")
        for d, stem in fx.STATUSES.items()
    )
    cases = (
        f"SELECT region, replace(variable, '_cases', '') AS variable, sum(value)::DOUBLE AS total_cases, "
        + r("sum(value)::DOUBLE / count(DISTINCT year)", 6, "average_cases")
        + f", {shares} FROM (UNPIVOT (SELECT * FROM panel) ON {CASES} INTO NAME variable VALUE value) GROUP BY region, variable"
    )
    names = "CASE variable WHEN 'hum' THEN 'Human' WHEN 'catt' THEN 'Cattle' WHEN 'cam' THEN 'Camel' WHEN 'goat' THEN 'Goat' ELSE 'Sheep' END"
    return with_sql(
        f"SELECT * EXCLUDE (variable), {names} AS species FROM case_part JOIN rate_part USING (region, variable)",
        [
            ("yr", _YEARLY_RATES),
            ("case_part", cases),
            ("rate_part", f"SELECT region, variable, {_DESCRIBE} FROM yr GROUP BY region, variable"),
        ],
    )


@query("a8_summary_tables", _summary_sql())
def a8(spark, sf):
    panel = fx.rated_panel(spark, sf)
    return rounded(rollup.summary_table(panel, panel, fx.STATUSES, ["region"]))


# ---------------------------------------------------------------- windows


@query(
    "w1_pct_change",
    with_sql(
        "SELECT region, year, hum_cases, "
        + r("(hum_cases - b)::DOUBLE / nullif(b, 0) * 100", 6, "growth_rate")
        + " FROM (SELECT region, year, hum_cases, lag(hum_cases) OVER (PARTITION BY region ORDER BY year) AS b FROM (SELECT region, year, sum(hum_cases)::BIGINT AS hum_cases FROM panel GROUP BY region, year))"
    ),
)
def w1(spark, sf):
    yearly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "year"], ["hum_cases"])
    return rounded(windows.pct_change(yearly, ["region"], "year", "hum_cases"))


_LAGGED = ["catt_cases", "goat_cases"]


@query(
    "w2_lag_columns",
    with_sql(
        "SELECT region, month, hum_cases, lag(catt_cases, 3) OVER w AS catt_cases, lag(goat_cases, 3) OVER w AS goat_cases FROM regional_counts WINDOW w AS (PARTITION BY region ORDER BY month)"
    ),
)
def w2(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], ["hum_cases", *_LAGGED])
    return windows.lag_columns(monthly, ["region"], "month", _LAGGED, 3)


@query(
    "w3_difference",
    with_sql(
        "SELECT region, month, hum_cases - lag(hum_cases) OVER w AS hum_cases, shp_cases - lag(shp_cases) OVER w AS shp_cases FROM regional_counts WINDOW w AS (PARTITION BY region ORDER BY month)"
    ),
)
def w3(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], ["hum_cases", "shp_cases"])
    return windows.difference(monthly, ["region"], "month", ["hum_cases", "shp_cases"])


def _roll(c: str) -> str:
    return f"CASE WHEN count({c}) OVER w = 4 THEN avg({c}) OVER w END"


@query(
    "w4_rolling_mean",
    with_sql(
        "SELECT region, month, "
        + ", ".join(r(f"{s}_incidence") + ", " + r(_roll(f"{s}_incidence"), 6, f"smoothed_{s}_incidence") for s in SERIES)
        + " FROM regional_months WINDOW w AS (PARTITION BY region ORDER BY month ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    ),
)
def w4(spark, sf):
    monthly = fx.regional_months(spark, sf).select("region", "month", *rollup.RATE_PAIRS)
    return rounded(windows.rolling_mean(monthly, ["region"], "month", list(rollup.RATE_PAIRS)))


@query(
    "w5_group_total",
    "SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_partkey) AS part_quantity FROM lineitem",
)
def w5(spark, sf):
    items = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return windows.group_total(items, ["l_partkey"], "l_quantity", "part_quantity").drop("l_partkey")


@query(
    "w6_lag_expand",
    with_sql(
        "SELECT a.region, a.month, a.hum_cases, l.lag::INT AS lag, b.catt_cases FROM idx a CROSS JOIN range(0, 7) l(lag) LEFT JOIN idx b ON a.region = b.region AND b.k = a.k - l.lag",
        [("idx", "SELECT region, month, hum_cases, catt_cases, row_number() OVER (PARTITION BY region ORDER BY month) AS k FROM regional_counts")],
    ),
)
def w6(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], ["hum_cases", "catt_cases"])
    return windows.lag_expand(monthly, ["region"], "month", ["catt_cases"], range(7), keep=["hum_cases"])


# ---------------------------------------------------------------- sorting


@query("o1_sort", with_sql("SELECT region, month, diagnosis, hum_cases FROM panel ORDER BY region, month, diagnosis"))
def o1(spark, sf):
    return fx.base_panel(spark, sf).select("region", "month", "diagnosis", "hum_cases").orderBy("region", "month", "diagnosis")


# ---------------------------------------------------------------- classes

_Q = "[0.0, 0.25, 0.5, 0.75, 1.0]"


@query(
    "c1_quantile_breaks",
    with_sql(
        "SELECT " + ", ".join(r(f"q[{i + 1}]", 6, f"q{i}") for i in range(5)) + f" FROM (SELECT quantile_cont(nullif(value, 0), {_Q}) AS q FROM yr WHERE variable <> 'hum')",
        [("yr", _YEARLY_RATES)],
    ),
)
def c1(spark, sf):
    animal = [c for c in rollup.RATE_PAIRS if c != "hum_incidence"]
    sums = rollup.sum_by(fx.rated_panel(spark, sf), ["region", "year"], animal)
    pooled = sums.unpivot(["region", "year"], animal, "variable", "value")
    breaks = classify.quantile_breaks(pooled.withColumn("value", F.nullif("value", F.lit(0.0))), "value")
    return rounded(breaks.select(*[F.col("breaks")[i].alias(f"q{i}") for i in range(5)]))


def _class_sql(value: str, q: str, prefix: str) -> str:
    """Class of ``value`` among the distinct sorted edges ``q``."""
    inside = f"{value} BETWEEN {q}[1] AND {q}[-1]"
    index = f"CASE WHEN {inside} THEN 1 + len(list_filter({q}[2:len({q}) - 1], lambda b: b < {value})) ELSE 0 END"
    label = (
        f"CASE WHEN {inside} THEN printf('%.2f', round({q}[{index}], 2)) || '-' || "
        f"printf('%.2f', round(coalesce({q}[{index} + 1], {q}[-1]), 2)) ELSE '0' END"
    )
    return f"({index})::INT AS {prefix}_index, {label} AS {prefix}_label"


def _edges(value: str) -> str:
    return f"list_sort(list_distinct(quantile_cont({value}, {_Q})))"


@query(
    "c2_quantile_class",
    f"""WITH q AS (SELECT {_edges('l_extendedprice')} AS q FROM lineitem)
    SELECT class_index, class_label, count(*) AS n FROM (SELECT {_class_sql('l_extendedprice', 'q', 'class')} FROM lineitem, q) GROUP BY ALL""",
)
def c2(spark, sf):
    items = fx.table(spark, sf, "lineitem").select("l_extendedprice")
    classed = classify.quantile_class(items, "l_extendedprice")
    return classed.groupBy("class_index", "class_label").agg(F.count(F.lit(1)).alias("n"))


_ANIMALS = SERIES[1:]


def _map_sql() -> str:
    wide = ", ".join(
        r(f"max(value) FILTER (WHERE variable = '{a}')", 6, f"value_{a}_incidence")
        + f", max(cat_index) FILTER (WHERE variable = '{a}') AS cat_index_{a}_incidence, max(cat_label) FILTER (WHERE variable = '{a}') AS cat_label_{a}_incidence"
        for a in _ANIMALS
    )
    return with_sql(
        f"""SELECT replace(h.region, '_', '-') AS region, h.year, {r('h.value', 6, 'hum_incidence')}, h.human_index, h.human_label, w.* EXCLUDE (region, year), r_name
        FROM h JOIN w ON h.region = w.region AND h.year = w.year JOIN nation n ON n.n_name = h.region JOIN region g ON g.r_regionkey = n.n_regionkey""",
        [
            ("yr", _YEARLY_RATES),
            ("hq", f"SELECT {_edges('value')} AS q FROM yr WHERE variable = 'hum'"),
            ("aq", f"SELECT {_edges('nullif(value, 0)')} AS q FROM yr WHERE variable <> 'hum'"),
            ("h", f"SELECT region, year, value, {_class_sql('value', 'q', 'human')} FROM yr, hq WHERE variable = 'hum'"),
            ("a", f"SELECT region, year, variable, value, {_class_sql('value', 'q', 'cat')} FROM (SELECT region, year, variable, nullif(value, 0) AS value FROM yr WHERE variable <> 'hum'), aq"),
            ("w", f"SELECT region, year, {wide} FROM a GROUP BY region, year"),
        ],
    )


@query("c3_map_table", _map_sql())
def c3(spark, sf):
    names = (
        fx.table(spark, sf, "nation")
        .join(fx.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.regexp_replace("n_name", "_", "-").alias("region"), "r_name")
    )
    return rounded(classify.map_table(fx.rated_panel(spark, sf), names, F.regexp_replace("region", "_", "-")))


@query(
    "c4_smoothed_long",
    with_sql(
        "SELECT month, regexp_extract(variable, '(hum|catt|cam|goat|shp)_', 1) AS series, CASE WHEN starts_with(variable, 'smoothed') THEN 'Smoothed' ELSE 'Original' END AS type, "
        + r("value")
        + f" FROM (UNPIVOT (SELECT * FROM sm WHERE {' AND '.join(f'{p}{s}_incidence IS NOT NULL' for s in SERIES for p in ('', 'smoothed_'))}) ON {', '.join(f'{p}{s}_incidence' for s in SERIES for p in ('', 'smoothed_'))} INTO NAME variable VALUE value)",
        [
            (
                "sm",
                "SELECT month, "
                + ", ".join(f"{s}_incidence, {_roll(f'{s}_incidence')} AS smoothed_{s}_incidence" for s in SERIES)
                + " FROM national_months WINDOW w AS (ORDER BY month ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
            )
        ],
    ),
)
def c4(spark, sf):
    return rounded(classify.smoothed_long(fx.national_months(spark, sf)))


# ---------------------------------------------------------------- from raw reports to panels


def _raw_tables(spark, sf):
    """Orders as raw sheets: case reports with loose spellings, monthly human counts, denominators."""
    orders = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = orders.join(fx.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    species = F.element_at(F.array(*map(F.lit, ("CATTLE ", "camels", "Goats", " sheep", "pigs"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    reports = named.select(
        F.date_format("o_orderdate", "MMMM").alias("month"),
        F.year("o_orderdate").alias("year"),
        F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("county"),
        F.when(F.col("o_orderstatus") == "P", "Anthrax").otherwise("suspected BRUCELLOSIS").alias("disease_condition"),
        F.when(F.col("o_orderstatus") == "O", "laboratory").alias("diagnosis"),
        species.alias("species"),
        (F.col("o_custkey") % 5 + 1).alias("no_sick"),
    )
    monthly = named.groupBy("n_name", F.trunc("o_orderdate", "month").alias("m")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("seen"), F.count_if(F.col("o_orderstatus") == "O").alias("tested")
    )
    human = monthly.select(
        F.concat(F.initcap(F.lower("n_name")), F.lit(" County")).alias("county"), F.date_format("m", "MMMM yyyy").alias("periodname"), "seen", "tested"
    )
    den = fx.denominators(spark, sf).withColumn("region", F.initcap(F.lower("region")))
    return reports, human, den


_TITLE = "upper(region[1]) || lower(region[2:])"


@query(
    "x1_raw_to_panel",
    with_sql(
        "SELECT region, year, month, diagnosis, hum_cases, "
        + ", ".join(f"{s}_cases::BIGINT AS {s}_cases" for s in ("catt", "cam", "goat", "shp"))
        + ", "
        + ", ".join(r(f"{s}_cases::DOUBLE / nullif({p}, 0)::DOUBLE * 1e6", 6, f"{s}_incidence") for s, p in POP.items())
        + " FROM (SELECT * REPLACE ("
        + ", ".join(f"CASE WHEN {c} {op} {limit} THEN round_even(avg({c}) OVER (), 0) ELSE {c} END AS {c}" for c, limit, op in V.OUTLIER_LIMITS)
        + ") FROM h FULL JOIN a USING (region, year, month, diagnosis))",
        [
            ("titled", f"SELECT {_TITLE} AS region, year, catt_pop, cam_pop, goat_pop, sheep_pop, pop FROM den"),
            (
                "counted",
                f"""SELECT {_TITLE} AS region, year(o.o_orderdate)::INT AS year, date_trunc('month', o.o_orderdate)::DATE AS month,
                CASE WHEN o.o_orderstatus = 'O' THEN 'Lab confirmed' ELSE 'Clinically confirmed' END AS diagnosis, left(o_orderpriority, 1) AS p, o_custkey % 5 + 1 AS n, o_orderstatus
                FROM orders o JOIN (SELECT *, n_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey) c ON o.o_custkey = c.c_custkey""",
            ),
            (
                "a",
                "SELECT c.*, catt_pop, cam_pop, goat_pop, sheep_pop FROM (SELECT region, year, month, diagnosis, "
                + ", ".join(f"sum(n) FILTER (WHERE p = '{i}')::BIGINT AS {s}_cases" for i, s in ((1, "catt"), (2, "cam"), (3, "goat"), (4, "shp")))
                + " FROM counted WHERE o_orderstatus <> 'P' AND p <> '5' GROUP BY ALL) c JOIN titled USING (region, year)",
            ),
            (
                "h",
                "SELECT m.region, m.year, m.month, d.diagnosis, CASE WHEN d.diagnosis = 'Lab confirmed' THEN tested ELSE seen END::DOUBLE AS hum_cases, pop FROM ("
                "SELECT region, year, month, count(*) FILTER (WHERE o_orderstatus = 'F') AS seen, count(*) FILTER (WHERE o_orderstatus = 'O') AS tested FROM counted GROUP BY ALL) m "
                "CROSS JOIN (VALUES ('Lab confirmed'), ('Clinically confirmed')) d(diagnosis) JOIN titled USING (region, year)",
            ),
        ],
    ),
)
def x1(spark, sf):
    """Raw sheets through cleaning, both panels and the base panel."""
    reports, monthly, den = _raw_tables(spark, sf)
    cleaned = panels.clean_reports(panels.stack_reports((reports, {c: c for c in panels.REPORT_COLUMNS})))
    animal = panels.animal_panel(cleaned, den.drop("pop"))
    human = panels.human_panel(monthly, den.select("region", "year", "pop"), {"Clinically confirmed": "seen", "Lab confirmed": "tested"})
    base = panels.base_panel(human, animal)
    counts = [F.col(c).cast("bigint") for c in ("catt_cases", "cam_cases", "goat_cases", "shp_cases")]
    return rounded(base.select(*panels.PANEL_KEYS, F.col("hum_cases").cast("double"), *counts, *rollup.RATE_PAIRS))
