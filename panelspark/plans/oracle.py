"""SQL text for checking the queries in another engine.

``with_sql`` puts the named building blocks a statement mentions in front of it.
Statistics are computed another way than in the operators where that is possible:
lags by self-join on a row number, least squares by the sweep operator, the t
distribution by gamma functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

SERIES = ["hum", "catt", "cam", "goat", "shp"]
POP = {"hum": "pop", "catt": "catt_pop", "cam": "cam_pop", "goat": "goat_pop", "shp": "sheep_pop"}
PRIORITY = {
    "hum": "1-URGENT",
    "catt": "2-HIGH",
    "cam": "3-MEDIUM",
    "goat": "4-NOT SPECIFIED",
    "shp": "5-LOW",
}
CASES = ", ".join(f"{s}_cases" for s in SERIES)
POPS = ", ".join(POP.values())
RATES = ", ".join(f"{s}_incidence" for s in SERIES)
SUM_CASES = ", ".join(f"sum({s}_cases)::BIGINT AS {s}_cases" for s in SERIES)
SUM_POPS = ", ".join(f"sum({p})::BIGINT AS {p}" for p in POP.values())
RATE_EXPRS = ", ".join(
    f"{s}_cases::DOUBLE / nullif({POP[s]}, 0)::DOUBLE * 1e6 AS {s}_incidence" for s in SERIES
)


def r(expr: str, digits: int = 6, alias: str | None = None) -> str:
    """Rounded, without a negative zero."""
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {alias or expr}"


ROUND_RATES = ", ".join(r(f"{s}_incidence") for s in SERIES)

COMMON: dict[str, str] = {
    "reports": """SELECT n.n_name AS region, date_trunc('month', o.o_orderdate)::DATE AS month,
        year(o.o_orderdate)::INT AS year, o.o_orderstatus AS diagnosis, o.o_orderpriority AS series
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "long_cases": """SELECT region, year, month, diagnosis, series, count(*) AS cases FROM reports
        GROUP BY region, year, month, diagnosis, series""",
    "panel": "SELECT region, year, month, diagnosis, "
    + ", ".join(f"count(*) FILTER (WHERE series = '{PRIORITY[s]}') AS {s}_cases" for s in SERIES)
    + " FROM reports GROUP BY region, year, month, diagnosis",
    "regional_den": """SELECT n.n_name AS region, count(*) * 1000 AS base_pop,
        count(*) FILTER (WHERE c_mktsegment = 'BUILDING') * 1000 AS catt_pop,
        count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') * 1000 AS goat_pop,
        count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') * 1000 AS sheep_pop,
        (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal < 3000) * 1000 AS cam_pop
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, n.n_nationkey""",
    "den": """SELECT region, y.year::INT AS year, catt_pop, goat_pop, sheep_pop, cam_pop,
        round_even(base_pop * (100 + (y.year - first) * 2) / 100.0::DOUBLE, 0)::BIGINT AS pop
        FROM regional_den, (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS year,
            min(year(o_orderdate)) AS first FROM orders) y""",
    "rated": f"""SELECT p.*, catt_pop, goat_pop, sheep_pop, cam_pop, pop, {RATE_EXPRS}
        FROM panel p JOIN den d ON p.region = d.region AND p.year = d.year""",
    "regional_counts": f"SELECT region, year, month, {SUM_CASES} FROM panel GROUP BY region, year, month",
    "regional_months": f"""SELECT p.*, catt_pop, goat_pop, sheep_pop, cam_pop, pop, {RATE_EXPRS}
        FROM regional_counts p JOIN den d ON p.region = d.region AND p.year = d.year""",
    "national_counts": f"SELECT year, month, {SUM_CASES} FROM panel GROUP BY year, month",
    "national_den": f"SELECT year, {SUM_POPS} FROM den GROUP BY year",
    "national_months": f"""SELECT p.*, {POPS}, {RATE_EXPRS}
        FROM national_counts p JOIN national_den d ON p.year = d.year""",
    "price_series": """SELECT region, month, sqrt(sum(o.o_totalprice)) AS value FROM (
        SELECT n.n_name AS region, date_trunc('month', o_orderdate)::DATE AS month, o_totalprice
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey) o
        GROUP BY region, month""",
}


def with_sql(select: str, extra: Sequence[tuple[str, str]] = (), recursive: bool = False) -> str:
    """``select`` preceded by the common blocks it or ``extra`` needs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in COMMON:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\s*\.)", text):
                visit(COMMON[name])
                if name not in needed:
                    needed.append(name)

    for _, body in extra:
        visit(body)
    visit(select)
    blocks = [(n, COMMON[n]) for n in needed] + list(extra)
    if not blocks:
        return select
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{name} AS ({body})" for name, body in blocks) + "\n" + select


def ols_sql(prefix: str, source: str, keys: Sequence[str], y: str, xs: Sequence[str]) -> list[tuple[str, str]]:
    """Blocks ending in ``{prefix}_fit``: n, rank, b0.., se0.., sse, sst per key, by sweeping each predictor."""
    k = len(xs)
    cols = [*xs, y]
    key = "".join(f"{c}, " for c in keys)
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    means = "".join(f", avg({x}) AS mx{i}" for i, x in enumerate(xs))
    cross = "".join(f", covar_pop({cols[i]}, {cols[j]}) * count(*) AS a{i}_{j}" for i, j in cells)
    base = "".join(f", a{i}_{i} AS d{i}" for i in range(k))
    blocks = [
        (f"{prefix}_m", f"SELECT {key}count(*) AS n, avg({y}) AS my{means}{cross} FROM {source}{group}"),
        (f"{prefix}_w0", f"SELECT *{base} FROM {prefix}_m"),
    ]

    def cell(i: int, j: int) -> str:
        return f"a{min(i, j)}_{max(i, j)}"

    carried = f"{key}n, my" + "".join(f", mx{i}" for i in range(k)) + "".join(f", d{i}" for i in range(k))
    for s in range(k):
        ok = f"({cell(s, s)} > 1e-12 * d{s})"
        out = []
        for i, j in cells:
            pivot = f"nullif({cell(s, s)}, 0)"
            if i == s and j == s:
                new = f"-1.0::DOUBLE / {pivot}"
            elif i == s or j == s:
                other = j if i == s else i
                new = f"{cell(other, s)} / {pivot}"
            else:
                new = f"a{i}_{j} - {cell(i, s)} * {cell(j, s)} / {pivot}"
            out.append(f"CASE WHEN {ok} THEN {new} ELSE a{i}_{j} END AS a{i}_{j}")
        flags = "".join(f", ok{m}" for m in range(s))
        blocks.append(
            (f"{prefix}_w{s + 1}", f"SELECT {carried}{flags}, {ok} AS ok{s}, {', '.join(out)} FROM {prefix}_w{s}")
        )
    rank = "1" + "".join(f" + ok{i}::INT" for i in range(k))
    b = [f"(CASE WHEN ok{i} THEN a{i}_{k} ELSE 0 END)" for i in range(k)]
    b0 = "my" + "".join(f" - {b[i]} * mx{i}" for i in range(k))
    v0 = "1.0::DOUBLE / n"
    for i in range(k):
        for j in range(k):
            v0 += f" + CASE WHEN ok{i} AND ok{j} THEN -{cell(i, j)} * mx{i} * mx{j} ELSE 0 END"
    s2 = f"(a{k}_{k} / nullif(greatest(n - ({rank}), 0), 0))"
    slopes = "".join(
        f", CASE WHEN ok{i} THEN a{i}_{k} END AS b{i + 1}, CASE WHEN ok{i} THEN sqrt({s2} * -a{i}_{i}) END AS se{i + 1}"
        for i in range(k)
    )
    blocks.append(
        (
            f"{prefix}_fit",
            f"SELECT {key}n, ({rank})::INT AS rank, {b0} AS b0, sqrt({s2} * ({v0})) AS se0{slopes}, "
            f"a{k}_{k} AS sse, sst FROM {prefix}_w{k} JOIN (SELECT {key}a{k}_{k} AS sst FROM {prefix}_m) "
            + (f"USING ({', '.join(keys)})" if keys else "ON true"),
        )
    )
    return blocks


def t_p_value(t: str, df: str) -> str:
    """Two-sided tail of Student's t for whole df, its finite sum with gamma-function coefficients."""
    c2 = f"({df} / ({df} + ({t}) * ({t})))"
    odd = (
        f"list_sum(list_transform(range(0, (({df}) // 2)::BIGINT), lambda j: "
        f"exp(2 * j * ln(2.0::DOUBLE) + 2 * lgamma(j + 1.0::DOUBLE) - lgamma(2 * j + 2.0::DOUBLE)) * pow({c2}, j + 0.5::DOUBLE)))"
    )
    even = (
        f"list_sum(list_transform(range(0, (({df}) // 2)::BIGINT), lambda j: "
        f"exp(lgamma(2 * j + 1.0::DOUBLE) - 2 * lgamma(j + 1.0::DOUBLE) - 2 * j * ln(2.0::DOUBLE)) * pow({c2}, j)))"
    )
    sin = f"(abs({t}) / sqrt({df} + ({t}) * ({t})))"
    return (
        f"CASE WHEN ({t}) IS NOT NULL THEN greatest(1 - CASE WHEN ({df}) % 2 = 1 THEN (2 / pi()) * (atan(abs({t}) / sqrt({df})) + {sin} * coalesce({odd}, 0)) "
        f"ELSE {sin} * coalesce({even}, 0) END, 0.0::DOUBLE) END"
    )
