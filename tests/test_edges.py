"""Zero denominators, empty groups, ties, gaps, singular fits, unreadable text."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.functions import vocab as V
from panelspark.operators import classify, forecast, joins, reshape, rollup, rows, series, windows
from panelspark.operators.regression import coef_table, fit_ols
from panelspark.plans import panels
from panelspark.sources import readers, sinks


def values(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def test_rate_of_zero_population_is_null(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (2, 4)], "c INT, p INT").select(C.rate(F.col("c"), F.col("p")).alias("r"))
    assert [r.r for r in df.collect()] == [None, None, 500000.0]


def test_sum_of_all_null_group_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "k STRING, v INT")
    assert values(rollup.sum_by(df, ["k"], ["v"]), "k", "v") == [("a", 0), ("b", 2)]


def test_row_sums(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "a INT, b INT")
    got = df.select(
        C.row_sum([F.col("a"), F.col("b")], True).alias("skip"), C.row_sum([F.col("a"), F.col("b")], False).alias("hard")
    ).collect()
    assert [(r.skip, r.hard) for r in got] == [(1, None), (3, 3)]


@pytest.mark.parametrize(
    "raw, title",
    [
        ("tharaka-nithi", "Tharaka-Nithi"),
        ("MURANG'A", "Murang'a"),
        (" elgeyo/marakwet ", "Elgeyo/Marakwet"),
        ("pm  &lb", "Pm &Lb"),
        ("canine(jackal)", "Canine(Jackal)"),
    ],
)
def test_title_case(spark, raw, title):
    assert spark.range(1).select(C.norm_text(F.lit(raw), "title")).first()[0] == title


def test_sentence_case(spark):
    assert spark.range(1).select(C.norm_text(F.lit("  KITUI   Central"), "sentence")).first()[0] == "Kitui central"


def test_species_passes_fold_to_one_map(spark):
    def one_by_one(label):
        for step in V.SPECIES_PASSES:
            label = step.get(label, label) if label is not None else None
        return label

    labels = sorted({k for step in V.SPECIES_PASSES for k in step} | {"Goats", "Sheep", "Camels", "Zebra"})
    df = spark.createDataFrame([(x,) for x in labels], "x STRING").select("x", C.recode(F.col("x"), V.SPECIES_MAP).alias("y"))
    assert {r.x: r.y for r in df.collect()} == {x: one_by_one(x) for x in labels}


def test_recode_default_takes_null_too(spark):
    df = spark.createDataFrame([("Lab",), (None,), ("odd",)], "x STRING")
    got = df.select(C.recode(F.col("x"), V.DIAGNOSIS_MAP, V.CLINICAL).alias("y")).collect()
    assert [r.y for r in got] == [V.LAB, V.CLINICAL, V.CLINICAL]


def test_months_and_numbers(spark):
    texts = ["January 2022", "jan 2022", "SEPTEMBER  2014", "3 2020", "Janvier 2022", "13 2020", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select(C.to_month(F.col("t")).alias("m"))
    d = dt.date
    assert [r.m for r in df.collect()] == [d(2022, 1, 1), d(2022, 1, 1), d(2014, 9, 1), d(2020, 3, 1), None, None, None]
    num = spark.createDataFrame([("1,234,567.5",), ("n/a",)], "t STRING").select(C.parse_number(F.col("t"), 1000).alias("v"))
    assert [r.v for r in num.collect()] == [1234567500.0, None]


def test_first_literal_only(spark):
    got = spark.range(1).select(C.remove_first(F.lit("A County County"), " County"), C.remove_first(F.lit("Bx"), " County"))
    assert tuple(got.first()) == ("A County", "Bx")


def test_display(spark):
    got = spark.range(1).select(
        C.count_with_share(F.lit(270), F.lit(427)), C.count_with_share(F.lit(0), F.lit(0)), C.range_label(F.lit("0.5-1234.5")), C.range_label(F.lit("0"))
    )
    assert tuple(got.first()) == ("270 (63.23%)", "0 (0.00%)", "0.50 – 1,234.50", "0")


def test_backcast_rounds_each_step(spark):
    df = spark.createDataFrame([("a", 1000, 3.3)], "region STRING, base INT, g DOUBLE")
    want, pop = {2019: 1000.0}, 1000.0
    for year in range(2018, 2013, -1):
        pop = float(round(pop * (1 - 3.3 / 100)))
        want[year] = pop
    assert {r.year: r.pop for r in rows.backcast(df, "base", "g", 2019, 5).collect()} == want


def test_outliers_both_means(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "v DOUBLE")
    assert values(rows.replace_outliers(df, [("v", 9, ">=")]), "v") == [(1.0,), (2.0,), (4.0,), (None,)]
    assert values(rows.replace_outliers(df, [("v", 8, ">")], "below"), "v") == [(1.0,), (2.0,), (2.0,), (None,)]


def test_tied_breaks_are_merged(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (4.0,), (None,)], "v DOUBLE")
    got = values(classify.quantile_class(df, "v"), "v", "class_index", "class_label")
    assert got == [(0.0, 1, "0.00-1.00")] * 3 + [(4.0, 2, "1.00-4.00"), (None, 0, "0")]


def test_constant_column_has_one_class(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v DOUBLE")
    assert values(classify.quantile_class(df, "v"), "class_index", "class_label") == [(1, "3.00-3.00")] * 2


def test_small_and_singular_groups_give_null(spark):
    data = [("few", 1.0, 1.0, 2.0), ("few", 2.0, 2.0, 1.0)]
    data += [("flat", float(i % 3), 0.0, float(i)) for i in range(8)]
    data += [("same", float(i * i), float(i), 2.0 * i) for i in range(8)]
    models = fit_ols(spark.createDataFrame(data, "k STRING, y DOUBLE, a DOUBLE, b DOUBLE"), ["k"], "y", ["a", "b"])
    got = {r.k: r for r in models.collect()}
    assert got["few"].rank == 2 and got["few"].coef[2] is None and got["few"].se[0] is None
    assert got["flat"].rank == 2 and got["flat"].coef[1] is None and got["flat"].coef[2] is not None
    assert got["same"].rank == 2 and got["same"].coef[2] is None
    assert coef_table(models, ["k"]).where(F.col("estimate").isNull() & F.col("significance").isNotNull()).count() == 0


def test_gaps_are_filled_within_a_series_only(spark):
    d = dt.date
    data = [("a", d(2020, 1, 1), 1.0), ("a", d(2020, 4, 1), 4.0), ("b", d(2020, 2, 1), 2.0)]
    got = values(windows.fill_months(spark.createDataFrame(data, "k STRING, month DATE, v DOUBLE"), ["k"], "month", ["v"], 0.0), "k", "month", "v")
    assert got == [("a", d(2020, m, 1), v) for m, v in ((1, 1.0), (2, 0.0), (3, 0.0), (4, 4.0))] + [("b", d(2020, 2, 1), 2.0)]


def test_lags_are_by_row(spark):
    d = dt.date
    data = [("a", d(2020, 1, 1), 1), ("a", d(2020, 6, 1), 2), ("b", d(2020, 6, 1), 7)]
    got = values(windows.lag_expand(spark.createDataFrame(data, "k STRING, month DATE, v INT"), ["k"], "month", ["v"], [0, 1]), "k", "month", "lag", "v")
    assert ("a", d(2020, 6, 1), 1, 1) in got and ("b", d(2020, 6, 1), 1, None) in got and len(got) == 6


def test_duplicate_month_fails(spark):
    d = dt.date
    data = [(d(2020, 1, 1), 1.0, 1.0), (d(2020, 1, 1), 2.0, 2.0)]
    df = spark.createDataFrame(data, "month DATE, hum_incidence DOUBLE, x DOUBLE")
    with pytest.raises(Exception, match="two rows for one month"):
        series.series_build(df, [], parts=["x"]).collect()


def test_window_not_full_is_null(spark):
    data = [(dt.date(2020, m, 1), v) for m, v in zip(range(1, 7), [1.0, 2.0, 3.0, 4.0, None, 6.0])]
    got = windows.rolling_mean(spark.createDataFrame(data, "month DATE, v DOUBLE"), [], "month", ["v"], 4)
    assert [r.smoothed_v for r in got.orderBy("month").collect()] == [None, None, None, 2.5, None, None]


def test_pivot_absent_cells(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k STRING, c STRING, v INT")
    assert values(reshape.pivot(df, ["k"], "c", {"x": "x", "y": "y"}, "v"), "k", "x", "y") == [("a", 1, None), ("b", None, 2)]
    assert values(reshape.pivot(df, ["k"], "c", {"x": "x", "y": "y"}, "v", 0), "k", "x", "y") == [("a", 1, 0), ("b", 0, 2)]


def test_filters_and_sets(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k STRING")
    assert values(rows.filter_in(df, "k", ["a"], keep=False), "k") == [("b",), (None,)]
    other = spark.createDataFrame([("b",)], "k STRING")
    assert values(joins.setdiff(df.dropna(), other, "k"), "k") == [("a",)]
    assert values(joins.setdiff(df, other, "k"), "k") == [("a",), (None,)]
    assert values(joins.setdiff(df, df, "k"), "k") == []


NULL_KEYS = [("a", 1.0), ("a", 3.0), (None, 5.0), (None, 6.0), ("b", None)]


def test_null_groups_stay(spark):
    df = spark.createDataFrame(NULL_KEYS, "k STRING, v DOUBLE")
    assert values(windows.group_total(df, ["k"], "v", "t"), "k", "v", "t") == sorted(
        [("a", 1.0, 4.0), ("a", 3.0, 4.0), (None, 5.0, 11.0), (None, 6.0, 11.0), ("b", None, None)], key=str
    )
    z = {(r.k, round(r.v, 3)) for r in rows.standardise(df.dropna(subset=["v"]), ["v"], ["k"]).collect()}
    assert z == {("a", -0.707), ("a", 0.707), (None, -0.707), (None, 0.707)}


def test_missing_keys_meet(spark):
    left = spark.createDataFrame([("a", None, 1), ("b", 2, 2)], "k STRING, y INT, l INT")
    right = spark.createDataFrame([("a", None, 10), (None, 2, 20)], "k STRING, y INT, r INT")
    assert values(joins.join_full(left, right, ["k", "y"]), "k", "y", "l", "r") == sorted(
        [("a", None, 1, 10), ("b", 2, 2, None), (None, 2, None, 20)], key=str
    )


def test_a_hot_group_is_spread(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 3)
    df = spark.range(20000).selectExpr("CASE WHEN id % 10 < 9 THEN 'hot' ELSE concat('k', id % 997) END AS k", "id AS v")
    out = windows.group_total(df, ["k"], "v", "t")
    sums = {r.k: (r.n, r.s) for r in df.selectExpr("*").groupBy("k").agg({"v": "sum", "*": "count"}).toDF("k", "s", "n").collect()}
    got = out.groupBy("k", "t").count().collect()
    assert {r.k: (r["count"], r.t) for r in got} == sums
    # rows of the hot group carry many keys into the shuffle of the second join
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "LeftOuter" in plan


def test_outlier_means_differ_by_column(spark):
    df = spark.createDataFrame([(1.0, 1.0), (9.0, 9.0), (2.0, 3.0)], "a DOUBLE, b DOUBLE")
    got = rows.replace_outliers(df, [("a", 5.0, ">"), ("b", 5.0, ">")], {"a": "all", "b": "below"})
    assert values(got, "a", "b") == [(1.0, 1.0), (2.0, 3.0), (4.0, 2.0)]


def test_seasons_without_a_list_of_years(spark):
    data = [(dt.date(y, m, 1), float(y + m)) for y in (1980, 2031) for m in (1, 12)]
    got = series.season_table(spark.createDataFrame(data, "month DATE, v DOUBLE"), [], "month", "v")
    assert values(got, "year", "month_of_year", "v") == [(1980, 1, 1981.0), (1980, 12, 1992.0), (2031, 1, 2032.0), (2031, 12, 2043.0)]


def test_long_series_has_the_lags_it_needs(spark):
    data = [("s", dt.date(1900 + i // 12, i % 12 + 1, 1), float((i * 37) % 23) + i * 0.01) for i in range(520)]
    data += [("t", dt.date(1900 + i // 12, i % 12 + 1, 1), float((i * 31) % 17)) for i in range(60)]
    got = series.adf(spark.createDataFrame(data, "name STRING, month DATE, value DOUBLE"), ["name"]).collect()
    assert {r["name"]: (r["k"], r["n_used"]) for r in got} == {"s": (8, 520 - 9), "t": (3, 60 - 4)}


def test_series_shorter_than_the_order_gives_no_limits(spark):
    data = [("s", dt.date(2020, m, 1), float(m)) for m in range(1, 5)]
    df = spark.createDataFrame(data, "k STRING, month DATE, value DOUBLE")
    assert forecast.forecast(forecast.fit_ar(df, ["k"], max_p=2), ["k"], 2, 2).count() == 2


def test_reader_and_sink(spark, tmp_path):
    path = str(tmp_path / "sheet.csv")
    with open(path, "w") as out:
        out.write('"",V1,V2\n1,County,2020 pop\n2,Kitui,"1,200"\n3,Nyeri,NA\n')
    got = readers.read_table(spark, path, header_row=1, syntactic_names=True).drop("X1")
    assert got.columns == ["County", "X2020.pop"]
    assert values(got.toDF("c", "p"), "c", "p") == [("Kitui", "1,200"), ("Nyeri", None)]
    plain = readers.read_table(spark, path)
    assert plain.columns == ["V1", "V2"]
    out_dir = str(tmp_path / "out")
    sinks.publish(spark.createDataFrame([("a", None)], "k STRING, v INT"), out_dir, "csv")
    assert values(readers.read_table(spark, out_dir, "k STRING, v INT"), "k", "v") == [("a", None)]
    mixed = str(tmp_path / "mixed.csv")
    with open(mixed, "w") as out:
        out.write('goat,note,cattle\n1,"a ""b"", c",2\nx,NA,4\n')
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        readers.read_table(spark, mixed, "cattle INT, goat INT").collect()
    counted = readers.read_table(spark, mixed, "cattle INT, goat INT, note STRING", bad_cells="bad")
    assert values(counted, "cattle", "goat", "note", "bad") == [(2, 1, 'a "b", c', 0), (4, None, None, 1)]
    with pytest.raises(ValueError, match="sheep"):
        readers.read_table(spark, mixed, "sheep INT")
    assert readers.clean_names(["No. sick", "year", "year", "1a", ""]) == ["No..sick", "year", "year.1", "X1a", "X"]
    sinks.save_bundle({"one": plain}, str(tmp_path / "bundle"))
    assert sinks.load_bundle(spark, str(tmp_path / "bundle"), ["one"])["one"].count() == 3


def test_group_totals_read_their_source_once(spark, tmp_path, monkeypatch):
    spark.range(50_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 20000 END AS k", "id AS v").write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(v):
        reads.add(1)
        return v

    source = spark.read.parquet(str(tmp_path / "t")).select("k", seen("v").alias("v"))
    out = joins.beside(source, ["k"], {"total": F.sum("v"), "rows": F.count(F.lit(1))})
    rows = out.collect()
    assert len(rows) == 50_000 and reads.value == 50_000
    plain = {r.k: (r.t, r.n) for r in source.groupBy("k").agg(F.sum("v").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    assert all((r.total, r.rows) == plain[r.k] for r in rows)
    # few rows: every group is hot
    few = joins.beside(source.limit(9_000), ["k"], {"n": F.count(F.lit(1))}).collect()
    assert len(few) == 9_000 and sum(r.n for r in few if r.k is None) == sum(1 for r in few if r.k is None) ** 2


def test_a_year_delivered_twice_replaces_itself(spark, tmp_path):
    cols = panels.SERIES_COLUMNS
    year = lambda y, cases: spark.createDataFrame(
        [(y, dt.date(y, m, 1), cases + m, *[float(m)] * (len(cols) - 3)) for m in range(1, 13)],
        "year INT, month DATE, " + ", ".join(f"{c} DOUBLE" for c in cols[2:]),
    )
    path = str(tmp_path / "panel")
    panels.publish_years(panels.extend_series(year(2020, 5.0), year(2021, 6.0)), path)
    files = lambda y: {f: f.stat().st_mtime_ns for f in (tmp_path / "panel" / f"year={y}").iterdir()}
    before = files(2020), files(2021)
    panels.publish_years(panels.extend_series(year(2022, 1.0)), path)
    once = sorted(map(tuple, panels.read_years(spark, path).collect()))
    panels.publish_years(panels.extend_series(year(2022, 1.0)), path)
    assert sorted(map(tuple, panels.read_years(spark, path).collect())) == once and len(once) == 36
    panels.publish_years(panels.extend_series(year(2022, 9.0)), path)
    got = panels.read_years(spark, path)
    assert got.columns == cols and got.count() == 36
    assert {r.year: r.c for r in got.groupBy("year").agg(F.min("hum_cases").alias("c")).collect()} == {2020: 6.0, 2021: 7.0, 2022: 10.0}
    assert (files(2020), files(2021)) == before


def test_unit_root_probabilities_rise_with_the_statistic(spark):
    rows_ = [(s / 20, n) for s in range(-120, 40) for n in (5, 25, 40, 80, 300, 10**6)] + [(None, 40)]
    got = spark.createDataFrame(rows_, "t DOUBLE, n BIGINT").withColumn("p", series.adf_p_value("t", "n")).collect()
    for n in (5, 25, 40, 80, 300, 10**6):
        p = [r.p for r in sorted((r for r in got if r.n == n and r.t is not None), key=lambda r: r.t)]
        assert p == sorted(p) and p[0] == 0.01 and p[-1] == 0.99
    at = {(r.t, r.n): r.p for r in got}
    assert at[None, 40] is None and at[-3.6, 25] == 0.05 and at[-3.6, 5] == 0.05
    # between 25 and 50 changes the cut of 5 % lies at -3.54, of 10 % at -3.204
    assert abs(at[-3.5, 40] - (0.05 + 0.05 * 0.04 / 0.336)) < 1e-12


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A driver elsewhere, with the package on its own path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from panelspark.operators import forecast, series
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = spark.range(36).selectExpr("add_months(date'2020-01-01', int(id)) AS month", "sin(id) + id AS value")
assert forecast.fit_ar_errors(df, [], max_p=1).count() == 1
assert forecast.fit_arma(df, [], max_p=1).count() == 1
assert series.decompose_local(df, []).count() == 36
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
