"""Count regressions with log link and exposure offset, for any number of keys at once.

All keys (lags, or regions and lags) are fitted together by reweighted least squares: an iteration is
one job that joins the rows to the latest coefficients of their key, aggregates the weighted
normal equations by key and solves them. Keys that have settled are set aside and their rows
are not read by later iterations. Coefficients stay in tables in the shared folder; the driver
sees only whether keys are left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import row_sum
from panelspark.functions.linalg import add_centred, add_steps, weighted_equations, weighted_steps, weighted_sums
from panelspark.functions.tails import digamma, normal_two_sided_p, trigamma
from panelspark.functions.vocab import ANIMALS
from panelspark.operators.joins import join_same
from panelspark.operators.regression import Z_90
from panelspark.operators.rows import standardise, step_codes
from panelspark.operators.windows import lag_expand
from panelspark.session import discard, materialise, materialise_at, scratch_path

ANIMAL_CASES = tuple(f"{s}_cases" for s in ANIMALS)


@dataclass(frozen=True)
class CountSpec:
    y: str = "hum_cases"
    xs: tuple[str, ...] = ANIMAL_CASES
    pop: str = "pop"
    region: str = "region"
    month: str = "month"
    lags: tuple[int, ...] = tuple(range(7))
    combined: bool = False
    region_effects: bool = False

    @property
    def predictors(self) -> list[str]:
        return ["animal_cases"] if self.combined else list(self.xs)

    @property
    def inputs(self) -> list[str]:
        return [*self.predictors, "time_code"]


def count_design(df: DataFrame, spec: CountSpec) -> DataFrame:
    """Rows (region, month, lag, y, predictors, time_code, log_pop), predictors standardised per lag.

    A predictor that never varies is left at 0.
    """
    base = df.select(
        spec.region,
        spec.month,
        F.bround(F.col(spec.y).cast("double"), 0).alias(spec.y),
        F.ln(F.when(F.col(spec.pop) > 0, F.col(spec.pop).cast("double"))).alias("log_pop"),
        *[F.col(x).cast("double").alias(x) for x in spec.xs],
    )
    coded = step_codes(base, [spec.region], spec.month, "time_code")
    rows = lag_expand(
        coded, [spec.region], spec.month, spec.xs, spec.lags, keep=[spec.y, "log_pop", "time_code"]
    ).dropna()
    if spec.combined:
        rows = rows.withColumn("animal_cases", row_sum([F.col(x) for x in spec.xs], skip_nulls=False))
    scaled = standardise(rows, spec.predictors, ["lag"])
    return scaled.select(
        spec.region,
        spec.month,
        "lag",
        spec.y,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in spec.predictors],
        F.col("time_code").cast("double").alias("time_code"),
        "log_pop",
    )


def linear(coef: Column, xs: Sequence[str]) -> Column:
    """Intercept plus slopes; a dropped predictor adds nothing."""
    terms = [F.coalesce(F.element_at(coef, i), F.lit(0.0)) * F.col(x) for i, x in enumerate(xs, 2)]
    return reduce(lambda a, b: a + b, terms, F.element_at(coef, 1))


def moved(new: Column, old: Column) -> Column:
    """The largest change of a coefficient, against 1 plus its size; null or NaN where a fit broke off."""
    gaps = F.zip_with(new, old, lambda a, b: F.coalesce(F.abs(a - b) / (1 + F.abs(a)), F.lit(0.0)))
    return F.when(F.element_at(new, 1).isNotNull(), F.array_max(gaps))  # no intercept: no fit


def settle(start: DataFrame, iterate, name: str, max_iter: int, tolerance: float) -> DataFrame:
    """Repeat ``iterate`` on the rows of a state table whose ``change`` is above the tolerance, until none is or ``max_iter`` is reached.

    A state is written in each round and read once by the next. A change that isn't a
    number ends a row as well; ``converged`` tells the others apart.
    """
    spark = start.sparkSession
    live, finished, paths = start, [], []
    open_ = (F.col("change") > tolerance) & ~F.isnan("change")
    for left in reversed(range(max_iter)):
        paths.append(scratch_path(spark, name))
        step = materialise_at(paths[-1], iterate(live))
        more = F.coalesce(open_, F.lit(False))
        still = step.where(more)
        ended = bool(left) and not still.isEmpty()
        finished.append(step.where(~more) if ended else step)
        if not ended:
            break
        live = still
    done = F.coalesce(F.col("change") <= tolerance, F.lit(False))
    result = materialise(reduce(DataFrame.unionByName, finished).withColumn("converged", done), f"{name}-settled")
    discard(*paths)
    return result


def fit_poisson(
    design: DataFrame, by: Sequence[str], spec: CountSpec, max_iter: int = 50, tolerance: float = 1e-9
) -> DataFrame:
    """Model table (by, n, coef, se, change, converged), coefficients in the order of ``["(Intercept)", *spec.inputs]``.

    A key without a single case has no finite intercept: its coefficients are null.
    """
    by, xs, y = list(by), spec.inputs, spec.y
    level = F.ln(F.try_divide(F.sum(y), F.sum(F.exp("log_pop"))))
    start = design.groupBy(*by).agg(
        F.array(level, *[F.lit(0.0) for _ in xs]).alias("coef"), F.lit(float("inf")).alias("change")
    )

    def iterate(state: DataFrame) -> DataFrame:
        joined = join_same(design, state.select(*by, F.col("coef").alias("_old")), by)
        joined = joined.withColumn("_eta", linear(F.col("_old"), xs)).withColumn("_mu", F.exp(F.col("_eta") + F.col("log_pop")))
        rows = joined.withColumn("_work", F.col("_eta") + (F.col(y) - F.col("_mu")) / F.col("_mu"))
        sums = weighted_equations(rows, by, "_work", xs, "_mu", [F.any_value("_old").alias("_old")])
        solved = add_steps(sums, weighted_steps(len(xs), "_fit"))
        fine = F.element_at("_old", 1).isNotNull()
        none = F.array(*[F.lit(None).cast("double")] * (len(xs) + 1))
        coef, se = (F.when(fine, F.col(f"_fit.{c}")).otherwise(none) for c in ("coef", "se"))
        return solved.select(*by, "n", coef.alias("coef"), se.alias("se"), moved(coef, F.col("_old")).alias("change"))

    return settle(start, iterate, "count-step", max_iter, tolerance)


#: The smallest excess variance that is told from none.
LEAST_EXCESS = 1e-6


def fit_linear_variance(
    design: DataFrame, by: Sequence[str], spec: CountSpec, max_iter: int = 50, tolerance: float = 1e-9
) -> DataFrame:
    """Negative binomial model whose variance is ``dispersion`` times the mean, by maximum likelihood: coefficients and dispersion together.

    Newton steps in the coefficients and the logarithm of the excess (dispersion - 1), from the Poisson
    fit and its Pearson dispersion; a step changes that logarithm by at most 1. A key whose counts vary no more than
    Poisson counts ends at ``LEAST_EXCESS``, which is the Poisson fit. Model table as
    ``fit_poisson``, with ``dispersion``.
    """
    by, xs, y = list(by), spec.inputs, spec.y
    k = len(xs)
    poisson = pearson(design, fit_poisson(design, by, spec, max_iter, tolerance), by, spec)
    excess = F.ln(F.greatest(F.coalesce(F.col("dispersion"), F.lit(1.0)) - 1, F.lit(0.01)))
    start = poisson.select(*by, F.concat("coef", F.array(excess)).alias("coef"), F.lit(float("inf")).alias("change"))

    def iterate(state: DataFrame) -> DataFrame:
        rows = join_same(design, state.select(*by, F.col("coef").alias("_old")), by)
        rows = rows.withColumn("_eta", linear(F.col("_old"), xs)).withColumn("_theta", F.element_at("_old", k + 2))
        rows = rows.withColumn("_excess", F.exp("_theta")).withColumn("_a", F.exp(F.col("_eta") + F.col("log_pop")) / F.col("_excess"))
        rows = add_steps(
            rows,
            {
                "_share": "_excess / (1 + _excess)",
                # likelihood in a = mean / excess: ln G(y + a) - ln G(a) - a ln(1 + excess) + y ln(share)
                "_slope": f"_a * ({digamma(f'(`{y}` + _a)')} - {digamma('_a')} - ln(1 + _excess))",
                "_bend": f"_a * _a * ({trigamma('_a')} - {trigamma(f'(`{y}` + _a)')})",
                "_hee": "_bend - _slope",
                "_het": "_slope - _bend + _a * _share",
                "_htt": f"_bend - _slope - _a * _share * (1 + _share) + `{y}` * _share * (1 - _share)",
                "_se": "_slope",
                "_st": f"`{y}` * (1 - _share) - _a * _share - _slope",
                "_re": "_hee * _eta + _het * _theta + _se",
                "_rt": "_het * _eta + _htt * _theta + _st",
            },
        )
        sums = {"_w": "_hee", f"_t{k}": "_het", f"_t{k + 1}": "_re", f"_q{k}_{k}": "_htt", f"_q{k + 1}_{k}": "_rt", f"_q{k + 1}_{k + 1}": "0D"}
        for i, a in enumerate(xs):
            sums |= {f"_t{i}": f"_hee * `{a}`", f"_q{k}_{i}": f"_het * `{a}`", f"_q{k + 1}_{i}": f"_re * `{a}`"}
            sums |= {f"_q{j}_{i}": f"_hee * `{a}` * `{xs[j]}`" for j in range(i, k)}
        total = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.any_value("_old").alias("_old"), *[F.sum(F.expr(e)).alias(c) for c, e in sums.items()]
        )
        solved = add_steps(add_centred(total, k + 1), weighted_steps(k + 1, "_fit"))
        old, new = F.element_at("_old", k + 2), F.element_at("_fit.coef", k + 2)
        theta = F.greatest(F.least(F.greatest(F.coalesce(new, old), old - 1), old + 1), F.ln(F.lit(LEAST_EXCESS)))
        none = F.array(*[F.lit(None).cast("double")] * (k + 2))
        fine = F.element_at("_old", 1).isNotNull()
        coef = F.when(fine, F.concat(F.slice("_fit.coef", 1, k + 1), F.array(theta))).otherwise(none)
        return solved.select(
            *by, "n", coef.alias("coef"), F.when(fine, F.col("_fit.se")).otherwise(none).alias("se"), moved(coef, F.col("_old")).alias("change")
        )

    found = settle(start, iterate, "linear-variance", max_iter, tolerance)
    return found.select(
        *by, "n", F.slice("coef", 1, k + 1).alias("coef"), F.slice("se", 1, k + 1).alias("se"),
        (1 + F.exp(F.element_at("coef", k + 2))).alias("dispersion"), "change", "converged",
    )


def _block_steps(k: int, time: int) -> dict[str, str]:
    """Sums of a region less what its own level and time slope take up, under the names of the sums with prefix ``_e``.

    With S the block's sums and G the effects' covariance, T = G (1 + S G)^-1 is the
    covariance given the data; no effect (G = 0) leaves the sums as they are. An unlimited
    variance (``_g00`` null) is the fit with a dummy a region.
    """
    block = lambda i: (f"_t{i}", f"_q{max(i, time)}_{min(i, time)}")
    s00, s01, s11 = "_w", f"_t{time}", f"_q{time}_{time}"
    m00, m01 = f"(1D + {s00} * _g00 + {s01} * _g01)", f"({s00} * _g01 + {s01} * _g11)"
    m10, m11 = f"({s01} * _g00 + {s11} * _g01)", f"(1D + {s01} * _g01 + {s11} * _g11)"
    steps = {
        "_det": f"{m00} * {m11} - {m01} * {m10}",
        "_k00": f"CASE WHEN _g00 IS NULL THEN try_divide(1D, _w) ELSE (_g00 * {m11} - _g01 * {m10}) / _det END",
        "_k01": f"CASE WHEN _g00 IS NULL THEN 0D ELSE (_g01 * {m00} - _g00 * {m01}) / _det END",
        "_k11": f"CASE WHEN _g00 IS NULL THEN 0D ELSE (_g11 * {m00} - _g01 * {m01}) / _det END",
    }

    def less(total: str, a: tuple[str, str], b: tuple[str, str]) -> str:
        return f"{total} - (_k00 * {a[0]} * {b[0]} + _k01 * ({a[0]} * {b[1]} + {a[1]} * {b[0]}) + _k11 * {a[1]} * {b[1]})"

    one = (s00, s01)
    steps["_e_w"] = f"CASE WHEN _g00 IS NULL THEN 0D ELSE {less('_w', one, one)} END"
    for i in range(k + 1):
        steps[f"_e_t{i}"] = f"CASE WHEN _g00 IS NULL THEN 0D ELSE {less(f'_t{i}', block(i), one)} END"
        steps |= {f"_e_q{j}_{i}": less(f"_q{j}_{i}", block(i), block(j)) for j in range(i, k + 1)}
    return steps


def fit_region_effects(
    design: DataFrame,
    spec: CountSpec,
    variance: float | None = None,
    slope: bool = False,
    max_iter: int = 200,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Poisson model with an effect of each region that shrinks to 0: one row per (lag, region).

    Every iteration linearises the model, reduces each region to its sums, takes its
    effect out of them in the region's own row, adds the rest up to the equations of the shared
    coefficients, and finds the effects from those. A given ``variance`` of the effects is kept (0:
    one level for all; infinite: a dummy a region); without one it is estimated along the way, as
    the mean over regions of squared effect plus its own variance. ``slope`` adds an effect on
    ``time_code`` and estimates all of their covariance.

    Columns: coef, se and root (of the shared coefficients; the intercept is 0 with dummies), effect,
    time_effect, effect_se (given the shared coefficients), weight and means of the region,
    g00, g01, g11 (covariance of the effects), change and converged.
    """
    region, xs, y, k = spec.region, spec.inputs, spec.y, len(spec.inputs)
    time = xs.index("time_code")
    unlimited = variance == float("inf")
    if slope and variance is not None:
        raise ValueError("a given variance is that of levels only")
    first = F.lit(None).cast("double") if unlimited else F.lit(float(1.0 if variance is None else variance))
    level = F.ln(F.try_divide(F.sum(y), F.sum(F.exp("log_pop"))))
    shared = design.groupBy("lag").agg(F.array(level, *[F.lit(0.0) for _ in xs]).alias("coef"))
    start = join_same(design.select("lag", region).distinct(), shared, ["lag"]).select(
        "lag", region, "coef", F.lit(0.0).alias("effect"), F.lit(0.0).alias("time_effect"), first.alias("g00"),
        F.lit(0.0).alias("g01"), F.lit(0.01 if slope else 0.0).alias("g11"), F.lit(float("inf")).alias("change"),
    )
    state = ["coef", "effect", "time_effect", "g00", "g01", "g11"]
    written: list[str] = []

    def iterate(live: DataFrame) -> DataFrame:
        old = live.select("lag", region, *[F.col(c).alias(f"_o_{c}") for c in state])
        rows = join_same(design, old, ["lag", region])
        eta = linear(F.col("_o_coef"), xs) + F.col("_o_effect") + F.col("_o_time_effect") * F.col("time_code")
        rows = rows.withColumn("_eta", eta).withColumn("_mu", F.exp(F.col("_eta") + F.col("log_pop")))
        rows = rows.withColumn("_work", F.col("_eta") + (F.col(y) - F.col("_mu")) / F.col("_mu"))
        carried = [F.any_value(f"_o_{c}").alias(f"_o_{c}") for c in state]
        sums = rows.groupBy("lag", region).agg(F.count(F.lit(1)).alias("n"), *weighted_sums([*xs, "_work"], "_mu"), *carried)
        sums = sums.withColumns({f"_{g}": F.col(f"_o_{g}") for g in ("g00", "g01", "g11")})
        written.append(scratch_path(design.sparkSession, "region-sums"))
        reduced = materialise_at(written[-1], add_steps(sums, _block_steps(k, time)))
        names = [c.removeprefix("_e") for c in reduced.columns if c.startswith("_e_")]
        total = reduced.groupBy("lag").agg(*[F.sum(f"_e{c}").alias(c) for c in names])
        solved = add_steps(add_centred(total, k), weighted_steps(k, "_fit")).select("lag", "_fit.*")
        both = join_same(reduced, solved, ["lag"])
        at = lambda i: F.coalesce(F.element_at("coef", i), F.lit(0.0))
        rest = lambda t, sides: F.col(t) - reduce(lambda a, b: a + b, [at(i) * F.col(c) for i, c in enumerate(sides, 1)])
        q = lambda i: f"_q{max(i, time)}_{min(i, time)}"
        own = rest(f"_t{k}", ["_w", *[f"_t{i}" for i in range(k)]])
        own_time = rest(q(k), [f"_t{time}", *[q(i) for i in range(k)]])
        both = both.withColumns({"_own": own, "_own_time": own_time}).withColumns(
            {
                "effect": F.col("_k00") * F.col("_own") + F.col("_k01") * F.col("_own_time"),
                "time_effect": F.col("_k01") * F.col("_own") + F.col("_k11") * F.col("_own_time"),
            }
        )
        means = F.array(*[F.try_divide(f"_t{i}", "_w") for i in range(k)])
        made = both.select(
            "lag", region, "n", "coef", "se", "root", "effect", "time_effect", F.sqrt("_k00").alias("effect_se"),
            F.col("_w").alias("weight"), means.alias("means"), "_k00", "_k01", "_k11", *[f"_o_{c}" for c in state],
        )
        if variance is None:
            estimate = {"g00": F.col("effect") ** 2 + F.col("_k00")}
            if slope:
                estimate |= {
                    "g01": F.col("effect") * F.col("time_effect") + F.col("_k01"),
                    "g11": F.col("time_effect") ** 2 + F.col("_k11"),
                }
            spread = made.groupBy("lag").agg(*[F.avg(e).alias(g) for g, e in estimate.items()])
            spread = spread.withColumns({g: F.lit(0.0) for g in ("g00", "g01", "g11") if g not in estimate})
            made = join_same(made, spread.select("lag", "g00", "g01", "g11"), ["lag"])
        else:
            made = made.withColumns({g: F.col(f"_o_{g}") for g in ("g00", "g01", "g11")})
        list_of = lambda p: F.concat(F.col(f"{p}coef"), F.array(*[F.coalesce(F.col(f"{p}{c}"), F.lit(0.0)) for c in state[1:]]))
        change = made.groupBy("lag").agg(F.max(moved(list_of(""), list_of("_o_"))).alias("change"))
        return join_same(made, change, ["lag"]).drop("_k00", "_k01", "_k11", *[f"_o_{c}" for c in state])

    result = settle(start, iterate, "region-step", max_iter, tolerance)
    discard(*written)
    return result


def dummy_terms(effects: DataFrame, spec: CountSpec) -> DataFrame:
    """Model table (lag, terms, coef, se, dispersion, converged) of a fit with unlimited variance: regions against the one with the most rows, whose level is the intercept."""
    base = effects.groupBy("lag").agg(
        F.max_by(F.struct(F.col(spec.region).alias("name"), "effect", "weight", "means"), F.struct("n", F.col(spec.region))).alias("_base")
    )
    rows = join_same(effects, base, ["lag"])
    is_base = F.col(spec.region).eqNullSafe(F.col("_base.name"))

    def spread(gap: Column) -> Column:
        dots = F.transform("root", lambda v: F.aggregate(F.zip_with(v, gap, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
        return F.aggregate(F.transform(dots, lambda d: d * d), F.lit(0.0), lambda s, x: s + x)

    gap = F.when(is_base, F.col("means")).otherwise(F.zip_with("means", F.col("_base.means"), lambda a, b: a - b))
    own = F.try_divide(F.lit(1.0), F.col("weight"))
    variance = spread(gap) + F.when(is_base, own).otherwise(own + F.try_divide(F.lit(1.0), F.col("_base.weight")))
    estimate = F.when(is_base, F.col("effect")).otherwise(F.col("effect") - F.col("_base.effect"))
    name = F.when(is_base, "(Intercept)").otherwise(F.concat(F.lit("region_"), F.coalesce(F.col(spec.region).cast("string"), F.lit(""))))
    regional = rows.select("lag", name.alias("term"), estimate.alias("estimate"), F.sqrt(variance).alias("std_error"), "converged")
    shared = effects.groupBy("lag").agg(F.any_value("coef").alias("coef"), F.any_value("se").alias("se"), F.any_value("converged").alias("converged"))
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in spec.inputs]).alias("term"), F.slice("coef", 2, len(spec.inputs)).alias("estimate"), F.slice("se", 2, len(spec.inputs)).alias("std_error"))
    return shared.select("lag", F.inline_outer(pairs), "converged").select("lag", "term", "estimate", "std_error", "converged").unionByName(regional)


def pearson(design: DataFrame, models: DataFrame, by: Sequence[str], spec: CountSpec) -> DataFrame:
    """The model table with ``dispersion``: Pearson's sum of squares a degree of freedom."""
    by = list(by)
    rows = join_same(design, models.select(*by, "coef"), by)
    mu = F.exp(linear(F.col("coef"), spec.inputs) + F.col("log_pop"))
    rows = rows.withColumn("_mu", mu)
    chi = rows.groupBy(*by).agg(F.sum((F.col(spec.y) - F.col("_mu")) ** 2 / F.col("_mu")).alias("_chi"))
    rank = F.size(F.filter("coef", lambda c: c.isNotNull()))
    joined = join_same(models, chi, by)
    free = F.col("n") - rank
    return joined.withColumn("dispersion", F.try_divide("_chi", F.when(free > 0, free.cast("double")))).drop("_chi")


def coefficients(models: DataFrame, by: Sequence[str], terms: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per key and term, with the statistic and its normal tail."""
    pairs = F.arrays_zip(F.array(*[F.lit(t) for t in terms]).alias("term"), F.col("coef").alias("estimate"), F.col("se").alias("std_error"))
    table = models.select(*by, *extra, F.inline_outer(pairs)).select(*by, "term", "estimate", "std_error", *extra)
    z = F.try_divide(F.col("estimate"), F.col("std_error"))
    return table.withColumn("statistic", z).withColumn("p_value", normal_two_sided_p("statistic"))


def fit_count_model(
    df: DataFrame,
    spec: CountSpec = CountSpec(),
    family: str = "poisson",
    max_iter: int = 50,
    by_region: bool = False,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Coefficient table (lag, term, estimate, std_error, dispersion, converged, statistic, p_value).

    ``family="quasipoisson"`` keeps the mean model and scales the errors by the
    square root of the Pearson dispersion; ``"linear"`` is the negative binomial model with that kind of variance. With ``by_region`` every region has its own fit for each lag.
    With ``spec.region_effects`` (Poisson, one fit a lag) regions but the one with the most rows have a term of their own.
    ``converged`` is false where ``max_iter`` iterations did not reach the tolerance.
    """
    if family not in ("poisson", "quasipoisson", "linear") or spec.region_effects and (by_region or family != "poisson"):
        raise ValueError(f"unknown family {family!r}, or not one with these region effects")
    by = [spec.region, "lag"] if by_region else ["lag"]
    design = materialise(count_design(df, spec), "count-design")
    if spec.region_effects:
        terms = dummy_terms(fit_region_effects(design, spec, float("inf"), False, max_iter, tolerance), spec)
        z = F.try_divide(F.col("estimate"), F.col("std_error"))
        made = terms.withColumns({"dispersion": F.lit(1.0), "statistic": z})
        return made.withColumn("p_value", normal_two_sided_p("statistic"))
    fit = fit_linear_variance if family == "linear" else fit_poisson
    models = fit(design, by, spec, max_iter, tolerance)
    if family == "quasipoisson":
        models = pearson(design, models, by, spec).withColumn("se", F.transform("se", lambda s: s * F.sqrt("dispersion")))
    elif family == "poisson":
        models = models.withColumn("dispersion", F.lit(1.0))
    return coefficients(models, by, ["(Intercept)", *spec.inputs], ["dispersion", "converged"])


def rate_ratios(
    coefs: DataFrame, drop: Sequence[str] = ("time_code", "(Intercept)"), by: Sequence[str] = ("lag",)
) -> DataFrame:
    """Exponentiated estimates with 90 % limits, for every key."""
    return coefs.where(~F.col("term").isin(list(drop))).select(
        *by,
        "term",
        F.exp("estimate").alias("rate_ratio"),
        F.exp(F.col("estimate") - F.lit(Z_90) * F.col("std_error")).alias("conf_low"),
        F.exp(F.col("estimate") + F.lit(Z_90) * F.col("std_error")).alias("conf_high"),
        "statistic",
        "p_value",
    )
