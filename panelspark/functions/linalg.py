"""Least squares for many small groups as Column expressions.

Groups are reduced to means and centred cross products with built-in covariance
aggregates, which combine partial results before the shuffle and need no second
pass for centring. The k-by-k system of each group is then factored in a
projection, one step per column, so nothing leaves the JVM. The steps are written
as expression text, a few hundred terms of Column objects being slow to build.

Results are unnested with the ``_outer`` generators: the plain ones make the
optimizer infer a size filter and push it, expanded, below every one of these steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a pivot below this share of its diagonal marks a column as a combination of earlier ones
PIVOT_TOLERANCE = 1e-12


def _sum(parts: Sequence[str]) -> str:
    return "(" + " + ".join(parts) + ")" if parts else "0D"


def _less(first: str, parts: Sequence[str]) -> str:
    return f"({first} - {_sum(parts)})" if parts else first


Steps = dict[str, str]


PIECE = 60


def add_steps(df: DataFrame, steps: Steps) -> DataFrame:
    """Add columns that may refer to each other in the order given (lateral aliases): one projection chain.

    The analyzer takes a round for each level of references, and has a limit, so long chains go in pieces.
    """
    texts = [f"{text} AS {name}" for name, text in steps.items()]
    for at in range(0, len(texts), PIECE):
        df = df.selectExpr("*", *texts[at : at + PIECE])
    return df


def normal_equations(
    df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], extra: Sequence[Column] = ()
) -> DataFrame:
    """One row per group: count, means, centred cross products. Rows must be complete."""
    k = len(xs)
    aggs = ["count(1) AS n", f"avg({y}) AS _ay", f"var_pop({y}) AS _vyy"]
    for i, a in enumerate(xs):
        aggs += [f"avg({a}) AS _a{i}", f"covar_pop({a}, {y}) AS _vy{i}", f"var_pop({a}) AS _v{i}_{i}"]
        aggs += [f"covar_pop({a}, {xs[j]}) AS _v{j}_{i}" for j in range(i + 1, k)]
    moments = df.groupBy(*by).agg(*[F.expr(a) for a in aggs], *extra)
    # a group has at least one complete row, so nothing is null; saying so to the
    # optimizer keeps null checks out of the generated code of all later steps
    scaled = {"_my": "coalesce(_ay, 0D)", "_syy": "coalesce(_vyy * n, 0D)"}
    for i in range(k):
        scaled[f"_mx{i}"] = f"coalesce(_a{i}, 0D)"
        scaled[f"_c{i}"] = f"coalesce(_vy{i} * n, 0D)"
        for j in range(i, k):
            scaled[f"_s{j}_{i}"] = f"coalesce(_v{j}_{i} * n, 0D)"
    kept = [c for c in moments.columns if not c.startswith(("_v", "_a"))]
    return moments.selectExpr(*[f"`{c}`" for c in kept], *[f"{text} AS {name}" for name, text in scaled.items()])


def weighted_equations(
    df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], w: str, extra: Sequence[Column] = ()
) -> DataFrame:
    """``normal_equations`` with a weight a row: also ``_w``, the sum of weights. One pass over plain sums; rows must be complete."""
    made = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *weighted_sums([*xs, y], w), *extra)
    return add_centred(made, len(xs))


def weighted_sums(cols: Sequence[str], w: str) -> list[Column]:
    """Sums of the weight (``_w``), of each column (``_t``) and of each product of two (``_q``)."""
    sums = [f"sum({w}) AS _w"] + [f"sum({w} * {c}) AS _t{i}" for i, c in enumerate(cols)]
    sums += [f"sum({w} * {a} * {cols[j]}) AS _q{j}_{i}" for i, a in enumerate(cols) for j in range(i, len(cols))]
    return [F.expr(a) for a in sums]


def add_centred(sums: DataFrame, k: int) -> DataFrame:
    """Weighted sums ``_w``, ``_t``, ``_q`` (predictors first, then the target) as means and centred cross products."""
    mean = lambda i: f"coalesce(try_divide(_t{i}, _w), 0D)"
    cross = lambda j, i: f"coalesce(_q{j}_{i} - _t{j} * {mean(i)}, 0D)"
    made = {"_my": mean(k), "_syy": cross(k, k)}
    for i in range(k):
        made |= {f"_mx{i}": mean(i), f"_c{i}": cross(k, i)}
        made |= {f"_s{j}_{i}": cross(j, i) for j in range(i, k)}
    kept = [c for c in sums.columns if not c.startswith(("_t", "_q"))]
    return sums.selectExpr(*[f"`{c}`" for c in kept], *[f"{text} AS {name}" for name, text in made.items()])


def weighted_steps(k: int, out: str) -> Steps:
    """Struct ``out`` for weights that are inverse variances: coefficients and standard errors, intercept first, null where a predictor dropped out.

    ``root`` are the rows of a matrix whose transpose times itself is the covariance of the slopes.
    """
    steps = {**factor_steps(k), **back_steps(k), **inverse_steps(k)}
    used = lambda j, text: f"CASE WHEN _r{j} > 0D THEN {text} END"
    coefs = ", ".join([intercept_text(k), *[used(j, f"_b{j}") for j in range(k)]])
    level = _sum(["try_divide(1D, _w)", *[f"_u{j} * _u{j}" for j in range(k)]])
    errors = [used(j, f"sqrt({_sum([f'_v{i}_{j} * _v{i}_{j}' for i in range(j, k)])})") for j in range(k)]
    root = ", ".join(f"array({', '.join([*[f'_v{i}_{j}' for j in range(i + 1)], *['0D'] * (k - i - 1)])})" for i in range(k))
    steps[out] = (
        f"named_struct('coef', array({coefs}), 'se', array({', '.join([f'sqrt({level})', *errors])}), 'root', array({root}))"
    )
    return steps


def pooled_steps(k: int, p: str) -> Steps:
    """Normal equations of the single predictor that is the sum of all ``k``, under prefix ``p``."""
    return {
        f"{p}_my": "_my",
        f"{p}_syy": "_syy",
        f"{p}_mx0": _sum([f"_mx{i}" for i in range(k)]),
        f"{p}_c0": _sum([f"_c{i}" for i in range(k)]),
        f"{p}_s0_0": _sum([f"_s{max(i, j)}_{min(i, j)}" for i in range(k) for j in range(k)]),
    }


def factor_steps(k: int, p: str = "") -> Steps:
    """Cholesky factor columns ``l``, inverse pivots ``r`` and projections ``z``.

    A dependent column gets an inverse pivot of 0 and drops out of everything
    after it, as in a pivotless rank-revealing fit.
    """
    steps: Steps = {}
    for j in range(k):
        steps[f"{p}_d{j}"] = _less(f"{p}_s{j}_{j}", [f"{p}_l{j}_{m} * {p}_l{j}_{m}" for m in range(j)])
        steps[f"{p}_r{j}"] = (
            f"coalesce(CASE WHEN {p}_d{j} > {PIVOT_TOLERANCE}D * {p}_s{j}_{j} "
            f"THEN try_divide(1D, sqrt({p}_d{j})) END, 0D)"
        )
        steps[f"{p}_z{j}"] = f"{_less(f'{p}_c{j}', [f'{p}_l{j}_{m} * {p}_z{m}' for m in range(j)])} * {p}_r{j}"
        for i in range(j + 1, k):
            inner = _less(f"{p}_s{i}_{j}", [f"{p}_l{i}_{m} * {p}_l{j}_{m}" for m in range(j)])
            steps[f"{p}_l{i}_{j}"] = f"{inner} * {p}_r{j}"
    return steps


def back_steps(k: int, p: str = "", keep: Callable[[int], str] | None = None) -> Steps:
    """Slope columns ``b``; ``keep(j)``, a condition, restricts the fit to a leading set of predictors."""
    steps: Steps = {}
    for j in reversed(range(k)):
        value = f"{_less(f'{p}_z{j}', [f'{p}_l{i}_{j} * {p}_b{i}' for i in range(j + 1, k)])} * {p}_r{j}"
        steps[f"{p}_b{j}"] = value if keep is None else f"CASE WHEN {keep(j)} THEN {value} ELSE 0D END"
    return steps


def inverse_steps(k: int, p: str = "") -> Steps:
    """Rows ``v`` of the inverse factor and ``u`` = inverse factor times the predictor means."""
    steps: Steps = {}
    for i in range(k):
        steps[f"{p}_v{i}_{i}"] = f"{p}_r{i}"
        for j in range(i):
            steps[f"{p}_v{i}_{j}"] = f"-{p}_r{i} * {_sum([f'{p}_l{i}_{m} * {p}_v{m}_{j}' for m in range(j, i)])}"
        steps[f"{p}_u{i}"] = _sum([f"{p}_v{i}_{j} * {p}_mx{j}" for j in range(i + 1)])
    return steps


def intercept_text(k: int, p: str = "") -> str:
    return _less(f"{p}_my", [f"{p}_b{j} * {p}_mx{j}" for j in range(k)])


def solve_steps(terms: Sequence[str], out: str, p: str = "") -> Steps:
    """Struct ``out``: terms, coefficients, standard errors (intercept first), rank, sse, sst."""
    k = len(terms)
    steps = {**factor_steps(k, p), **back_steps(k, p), **inverse_steps(k, p)}
    steps[f"{p}_rank"] = _sum(["1", *[f"CASE WHEN {p}_r{j} > 0D THEN 1 ELSE 0 END" for j in range(k)]])
    steps[f"{p}_sse"] = f"greatest({_less(f'{p}_syy', [f'{p}_z{j} * {p}_z{j}' for j in range(k)])}, 0D)"
    steps[f"{p}_s2"] = f"CASE WHEN n > {p}_rank THEN {p}_sse / (n - {p}_rank) END"
    variance0 = _sum(["try_divide(1D, n)", *[f"{p}_u{j} * {p}_u{j}" for j in range(k)]])
    variance = [_sum([f"{p}_v{i}_{j} * {p}_v{i}_{j}" for i in range(j, k)]) for j in range(k)]
    used = lambda j, text: f"CASE WHEN {p}_r{j} > 0D THEN {text} END"
    names = ", ".join(f"'{t}'" for t in ["(Intercept)", *terms])
    coefs = ", ".join([intercept_text(k, p), *[used(j, f"{p}_b{j}") for j in range(k)]])
    errors = ", ".join(
        [f"sqrt({p}_s2 * {variance0})", *[used(j, f"sqrt({p}_s2 * {variance[j]})") for j in range(k)]]
    )
    steps[out] = (
        f"named_struct('terms', array({names}), 'coef', array({coefs}), 'se', array({errors}), "
        f"'rank', {p}_rank, 'sse', {p}_sse, 'sst', {p}_syy)"
    )
    return steps
