"""Exact ranks and quantiles without a single-task sort.

A plain ``dense_rank`` or ``percentile`` sends a whole group to one task. Here the
distinct values of a group are written once with their counts. A group of at most
``BUCKET`` of them is ranked as it is; a larger one is cut at splits, and every bucket that is still
larger is cut again, until none is. Buckets are ranked side by side and their totals supply
the offsets. Splits come from values picked by a hash threshold, so no task sorts a group to find them and
a retried task finds the same ones. They only balance the work: results are exact for any splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.joins import join_same
from panelspark.session import discard, materialise, materialise_at, scratch_path

#: The most distinct values that one task ranks.
BUCKET = 50_000
#: A bucket is cut into at most WAYS parts at once, at every SPACING-th of the values picked.
WAYS, SPACING = 128, 8


def _cut(rows: DataFrame, keys: list[str], col: str, level: int) -> DataFrame:
    """``rows`` with ``_bucket`` refined where it holds more than BUCKET rows.

    About SPACING values are picked for each part that a bucket needs; the collected array has at most twice WAYS * SPACING of them.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    # parts of a third of a bucket: chance makes some of them larger
    parts = F.least(F.lit(WAYS), F.ceil(F.col("_size") * 3 / F.lit(BUCKET)))
    large = sizes.where(F.col("_size") > BUCKET).withColumn("_rate", parts * SPACING / F.col("_size"))
    chance = F.pmod(F.xxhash64(F.col(col), F.lit(level)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = join_same(rows.select(*keys, col), large, keys).where(chance < F.col("_rate"))
    ends = f"greatest(size(_all) div {SPACING}, 2)"
    every = F.expr(f"transform(sequence(1, {ends} - 1), i -> _all[greatest(int(i * size(_all) div {ends}) - 1, 0)])")
    splits = picked.groupBy(*keys).agg(F.sort_array(F.collect_list(col)).alias("_all")).select(*keys, every.alias("_splits"))
    mine = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    other = splits.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    same = mine[0]
    for one in mine[1:]:
        same &= one
    joined = rows.join(other, same, "left").drop(*[f"_s_{k}" for k in keys])
    # binary search in generated code: each step adds its width if the split there is below the value
    steps, at, width = [], "0", 2 * WAYS
    while width:
        below = f"coalesce(try_element_at(_splits, {at} + {width}) < `{col}`, false)"
        steps.append(f"{at} + CASE WHEN {below} THEN {width} ELSE 0 END AS _b{width}")
        at, width = f"_b{width}", width // 2
    found = joined.selectExpr(*[f"`{c}`" for c in joined.columns], *steps)
    refined = F.col("_bucket") * (4 * WAYS) + F.col(at)
    return found.select(*[c for c in rows.columns if c != "_bucket"], refined.alias("_bucket"))


def bucketed(rows: DataFrame, col: str, by: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """Written rows, one for each (by, col), with ``_bucket`` ascending in ``col``; whether any group has more than one."""
    spark, keys = rows.sparkSession, [*by, "_bucket"]
    out, level, path = rows.withColumn("_bucket", F.lit(0).cast("long")), 0, None
    while True:
        most = out.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if (most or 0) <= BUCKET:
            return out, level > 0
        level += 1
        before, path = path, scratch_path(spark, "buckets")
        out = materialise_at(path, _cut(out, keys, col, level))
        if before:
            discard(before)


def cumulative_counts(
    counts: DataFrame, col: str, count: str, by: Sequence[str] = (), ranks: Sequence[str] = ()
) -> DataFrame:
    """Add ``cum`` (running total of ``count`` in ``col`` order) and ``total``, within ``by``.

    ``counts`` has one row per (by, col). With ``ranks``, 0-based expressions over
    ``total``, only the buckets that hold one of them are ranked and returned; the
    others are neither shuffled nor sorted.
    """
    by = list(by)
    rows, several = bucketed(materialise(counts.where(F.col(count) > 0), "counts"), col, by)
    inside = Window.partitionBy(*by, "_bucket").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(count).over(inside)
    if not several:
        whole = F.sum(count).over(Window.partitionBy(*by, "_bucket"))
        return rows.withColumn("cum", running).withColumn("total", whole).drop("_bucket")
    # a row for each bucket: few beside the rows, however many groups there are
    order = Window.partitionBy(*by).orderBy("_bucket")
    totals = (
        rows.groupBy(*by, "_bucket")
        .agg(F.sum(count).alias("_n"))
        .withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
        .withColumn("total", F.sum("_n").over(Window.partitionBy(*by)))
    )
    if ranks:
        totals = totals.where(" OR ".join(f"({r} >= _before AND {r} < _before + _n)" for r in ranks))
    joined = join_same(rows, totals.drop("_n"), [*by, "_bucket"])
    return joined.withColumn("cum", running + F.col("_before")).drop("_bucket", "_before")


def exact_quantiles(
    df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), alias: str = "quantiles"
) -> DataFrame:
    """Linear-interpolation quantiles of the non-null values, one array per group."""
    by = list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_cnt"))
    position = [f"(total - 1) * {float(p)}D" for p in probs]
    ranks = [f"{end}({pos})" for pos in position for end in ("floor", "ceil")]
    ranked = cumulative_counts(counts, col, "_cnt", by, ranks)
    # the value at a 0-based rank is the smallest whose running count exceeds the rank
    at = lambda rank: f"min(CASE WHEN cum > {rank} THEN `{col}` END)"
    picked = ranked.groupBy(*by).agg(
        *[
            F.expr(text).alias(name)
            for i, pos in enumerate(position)
            for name, text in (
                (f"_lo{i}", at(f"floor({pos})")),
                (f"_hi{i}", at(f"ceil({pos})")),
                (f"_f{i}", f"max({pos} - floor({pos}))"),
            )
        ]
    )
    values = ", ".join(f"_lo{i} + (_hi{i} - _lo{i}) * _f{i}" for i in range(len(position)))
    return picked.selectExpr(*[f"`{k}`" for k in by], f"array({values}) AS {alias}")


def dense_codes(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (by, col) with ``code``: the 1-based position of the label in sort order."""
    labels = df.select(*by, col).where(F.col(col).isNotNull()).groupBy(*by, col).agg(
        F.max(F.lit(1)).alias("_one")
    )
    return cumulative_counts(labels, col, "_one", by).select(*by, col, F.col("cum").cast("int").alias("code"))
