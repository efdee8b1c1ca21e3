"""Queries of the sources, sinks and row-level operators (S*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.functions.vocab import CLINICAL, DIAGNOSIS_MAP, SPECIES_MAP, SPECIES_TO_SERIES
from panelspark.operators import joins, rows, rollup
from panelspark.plans import fixture as fx
from panelspark.plans.oracle import CASES, RATES, ROUND_RATES, SUM_CASES, r, with_sql
from panelspark.plans.registry import query, rounded
from panelspark.session import scratch_path
from panelspark.sources import readers, sinks

# ---------------------------------------------------------------- sources and sinks


@query(
    "s1_read_delimited",
    "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer",
)
def s1(spark, sf):
    path = scratch_path(spark, "s1")
    raw = fx.table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c acctbal")
    )
    sinks.publish(raw, path, "csv")
    # in another order than the file's
    schema = "c_name STRING, `c acctbal` DOUBLE, c_custkey BIGINT, c_nationkey INT"
    read = readers.read_table(spark, path, schema, syntactic_names=True)
    return read.withColumnRenamed("c.acctbal", "c_acctbal")


@query(
    "s2_promote_header",
    with_sql("SELECT region, base_pop, catt_pop FROM regional_den"),
)
def s2(spark, sf):
    path = scratch_path(spark, "s2")
    sheet = fx.regional_denominators(spark, sf).select(
        F.lit(1).alias("place"),
        F.col("region").alias("a"),
        F.col("base_pop").cast("string").alias("b"),
        F.col("catt_pop").cast("string").alias("c"),
    )
    head = readers.literal_rows(spark, [(0, "region", "base_pop", "catt_pop")], "place INT, a STRING, b STRING, c STRING")
    # a sheet of a few dozen regions, its header in the first data row, plus an index column without a name
    lines = sheet.unionByName(head).orderBy("place", "a").coalesce(1)
    lines.select(F.when(F.col("place") == 1, F.lit("7")).alias("_c0"), "a", "b", "c").write.option("header", True).csv(path)
    return readers.read_table(spark, path, "catt_pop BIGINT, region STRING, base_pop BIGINT", header_row=1)


@query("s3_region_dimension", "SELECT n_name AS region FROM nation")
def s3(spark, sf):
    return readers.region_dim(spark, f"{sf}/nation.parquet", "n_name")


@query("s4_denominator_tables", with_sql("SELECT * FROM den"))
def s4(spark, sf):
    return fx.denominators(spark, sf)


@query(
    "s5_inline_rows",
    with_sql(
        """SELECT region, month, sum(hum_cases)::BIGINT AS hum_cases FROM (
        SELECT region, month, hum_cases FROM panel
        UNION ALL SELECT * FROM (VALUES ('NATION_0', DATE '2002-01-01', NULL::BIGINT), ('NATION_0', DATE '2002-02-01', NULL::BIGINT))
        ) GROUP BY region, month"""
    ),
)
def s5(spark, sf):
    missing = readers.literal_rows(
        spark, [("NATION_0", "2002-01-01", None), ("NATION_0", "2002-02-01", None)], "region STRING, month STRING, hum_cases BIGINT"
    ).withColumn("month", F.col("month").cast("date"))
    stacked = joins.union_all(fx.base_panel(spark, sf).select("region", "month", "hum_cases"), missing)
    return stacked.groupBy("region", "month").agg(F.sum("hum_cases").alias("hum_cases"))


@query(
    "s6_write_delimited",
    with_sql(
        "SELECT year, region || ', \"' || diagnosis || '\" said' AS label, nullif(hum_cases, 0) AS hum_cases, "
        "CASE WHEN catt_cases > 1 THEN diagnosis END AS note FROM panel"
    ),
)
def s6(spark, sf):
    """Text with commas, quotes and missing cells, written delimited by year and read back."""
    path = scratch_path(spark, "s6")
    table = fx.base_panel(spark, sf).select(
        "year",
        F.concat("region", F.lit(', "'), "diagnosis", F.lit('" said')).alias("label"),
        F.expr("nullif(hum_cases, 0)").alias("hum_cases"),
        F.when(F.col("catt_cases") > 1, F.col("diagnosis")).alias("note"),
    )
    sinks.publish(table, path, "csv")
    return readers.read_table(spark, path, "hum_cases BIGINT, year INT, note STRING, label STRING")


@query(
    "s7_bundle",
    with_sql("SELECT p.region, p.year, month, hum_cases, pop FROM panel p JOIN den d ON p.region = d.region AND p.year = d.year WHERE diagnosis = 'F'"),
)
def s7(spark, sf):
    path = scratch_path(spark, "s7")
    sinks.save_bundle({"base_panel": fx.base_panel(spark, sf), "base_den": fx.denominators(spark, sf)}, path)
    sinks.load_bundle(spark, path, ["base_panel", "base_den"])
    return spark.sql(
        "SELECT p.region, p.year, month, hum_cases, pop FROM base_panel p JOIN base_den d USING (region, year) WHERE diagnosis = 'F'"
    )


# ---------------------------------------------------------------- projections and filters


@query(
    "p1_select_rename",
    """SELECT layout, month, count(*) AS n, round(sum(amount), 2) AS amount FROM (
    SELECT 'orders' AS layout, date_trunc('month', o_orderdate)::DATE AS month, o_totalprice AS amount FROM orders
    UNION ALL SELECT 'lineitem', date_trunc('month', l_shipdate)::DATE, l_extendedprice FROM lineitem
    UNION ALL SELECT 'events', date_trunc('month', ts)::DATE, value FROM events) GROUP BY layout, month""",
)
def p1(spark, sf):
    layouts = {"orders": ("o_orderdate", "o_totalprice"), "lineitem": ("l_shipdate", "l_extendedprice"), "events": ("ts", "value")}
    frames = [
        rows.conform(
            fx.table(spark, sf, name),
            {"layout": F.lit(name), "month": F.trunc(when, "month"), "amount": amount},
        )
        for name, (when, amount) in layouts.items()
    ]
    stacked = joins.union_all(*frames)
    return rounded(
        stacked.groupBy("layout", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")), digits=2
    )


@query(
    "p2_select_by_pattern",
    with_sql(f"SELECT region, month, diagnosis, {CASES}, catt_pop, goat_pop, sheep_pop, cam_pop FROM rated"),
)
def p2(spark, sf):
    panel = fx.rated_panel(spark, sf)
    pops = rows.cols_like(panel, "_pop", exclude="incidence", dtype="bigint")
    return panel.select("region", "month", "diagnosis", *rows.cols_like(panel, "cases"), *pops)


@query(
    "p3_map_columns",
    with_sql(
        "SELECT region, month, diagnosis, "
        + ", ".join(r(f"sqrt({c}_cases::DOUBLE)", 6, f"root_{c}_cases") for c in ("hum", "catt", "cam", "goat", "shp"))
        + " FROM panel"
    ),
)
def p3(spark, sf):
    panel = fx.base_panel(spark, sf)
    cases = rows.cols_like(panel, "cases")
    mapped = rows.across(panel, cases, lambda c: F.round(F.sqrt(c.cast("double")), 6), "root_{col}")
    return mapped.select("region", "month", "diagnosis", *rows.cols_like(mapped, prefix="root_"))


@query(
    "p4_filter_in",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
    WHERE l_returnflag IN ('A', 'N') AND l_linestatus NOT IN ('F') GROUP BY l_returnflag, l_linestatus""",
)
def p4(spark, sf):
    items = rows.filter_in(fx.table(spark, sf, "lineitem"), "l_returnflag", ["A", "N"])
    items = items.where(~F.col("l_linestatus").isin("F"))
    return rounded(
        items.groupBy("l_returnflag", "l_linestatus").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
        ),
        digits=2,
    )


@query(
    "p5_filter_present",
    """SELECT region, month, count(*) AS n FROM (
    SELECT CASE WHEN o_totalprice > 100000 THEN date_trunc('month', o_orderdate)::DATE END AS month,
           CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS region FROM orders)
    WHERE month IS NOT NULL AND region <> '' GROUP BY region, month""",
)
def p5(spark, sf):
    messy = fx.table(spark, sf, "orders").select(
        F.when(F.col("o_totalprice") > 100000, F.trunc("o_orderdate", "month")).alias("month"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderpriority")).alias("region"),
    )
    return rows.filter_present(messy, "month", "region").groupBy("region", "month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p6_complete_cases",
    with_sql(
        "SELECT region, year, count(*) AS n FROM rated WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in RATES.split(", "))
        + " GROUP BY region, year"
    ),
)
def p6(spark, sf):
    panel = fx.rated_panel(spark, sf)
    kept = rows.complete_cases(panel, rows.cols_like(panel, "incidence"))
    return kept.groupBy("region", "year").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p7_date_cutoff",
    with_sql(
        """SELECT region, sum(hum_cases) FILTER (WHERE month <= DATE '1999-12-01')::BIGINT AS upto,
        sum(hum_cases) FILTER (WHERE month > DATE '1999-12-01')::BIGINT AS after FROM panel GROUP BY region"""
    ),
)
def p7(spark, sf):
    panel = fx.base_panel(spark, sf)
    upto = rows.date_cutoff(panel, "month", "1999-12-01").select("region", F.col("hum_cases").alias("upto"), F.lit(None).cast("bigint").alias("after"))
    after = rows.date_cutoff(panel, "month", "1999-12-01", after=True).select("region", F.lit(None).cast("bigint").alias("upto"), F.col("hum_cases").alias("after"))
    return joins.union_all(upto, after).groupBy("region").agg(F.sum("upto").alias("upto"), F.sum("after").alias("after"))


# spellings cycled over the part sizes to make a dirty label column
_DIRTY = ["bobine", "Dogs/Donkey", "CATTLE", "sheep", "Goat", "camelidae", "Nd", "Pm &lb", "white tailed mongoose", "Lab"]


@query(
    "p8_recode",
    """WITH dirty AS (SELECT p_partkey, ['Bobine','Dogs/Donkey','Cattle','Sheep','Goat','Camelidae','Nd','Pm &Lb','White Tailed Mongoose','Lab'][p_size % 10 + 1] AS label FROM part),
    species AS (SELECT p_partkey, label, CASE label WHEN 'Bobine' THEN 'cattle' WHEN 'Dogs/Donkey' THEN 'Canine' WHEN 'Cattle' THEN 'cattle'
      WHEN 'Goat' THEN 'Goats' WHEN 'Camelidae' THEN 'Camels' WHEN 'Nd' THEN NULL WHEN 'White Tailed Mongoose' THEN 'Mongoose' ELSE label END AS species FROM dirty)
    SELECT p_partkey, species, CASE species WHEN 'cattle' THEN 'catt' WHEN 'Camels' THEN 'cam' WHEN 'Goats' THEN 'goat' WHEN 'Sheep' THEN 'shp' END AS series,
      CASE WHEN label IN ('Pm &Lb', 'Lab') THEN 'Lab confirmed' ELSE 'Clinically confirmed' END AS diagnosis FROM species""",
)
def p8(spark, sf):
    label = F.element_at(F.array(*[F.lit(x) for x in _DIRTY]), F.col("p_size") % 10 + 1)
    parts = fx.table(spark, sf, "part").select("p_partkey", C.norm_text(label, "title").alias("label"))
    species = C.recode(F.col("label"), SPECIES_MAP)
    return parts.select(
        "p_partkey",
        species.alias("species"),
        C.recode(species, SPECIES_TO_SERIES, default=None).alias("series"),
        C.recode(F.col("label"), DIAGNOSIS_MAP, CLINICAL).alias("diagnosis"),
    )


@query(
    "p9_regex_class",
    """SELECT lang, CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'notice' ELSE source END AS class, count(*) AS n
    FROM documents GROUP BY ALL""",
)
def p9(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        "lang", C.regex_class(F.col("text"), "(?i)license|copyright", "notice").alias("hit"), "source"
    )
    found = docs.select("lang", F.when(F.col("hit") == "notice", F.col("hit")).otherwise(F.col("source")).alias("class"))
    return found.groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"))


_TITLE = "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), '{sep}')"


@query(
    "p10_normalise_text",
    f"""SELECT p_partkey, {_TITLE.format(sep=' ')} AS title, {_TITLE.format(sep='-')} AS hyphened,
    upper(p_name[1]) || lower(p_name[2:]) AS sentence FROM part""",
)
def p10(spark, sf):
    name = F.col("p_name")
    padded = F.concat(F.lit("  "), F.upper(F.regexp_replace(name, " ", " \t ")), F.lit(" "))
    return fx.table(spark, sf, "part").select(
        "p_partkey",
        C.norm_text(padded, "title").alias("title"),
        C.norm_text(F.regexp_replace(name, " ", "-"), "title").alias("hyphened"),
        C.norm_text(padded, "sentence").alias("sentence"),
    )


@query(
    "p11_string_extract",
    """SELECT p_partkey, CASE WHEN instr(p_name, 'l') > 0 THEN p_name[1:instr(p_name, 'l') - 1] || p_name[instr(p_name, 'l') + 1:] ELSE p_name END AS first_removed,
    replace(p_name, 'l', '') AS all_removed, regexp_extract(p_name, 'small|large|red', 0) AS word, starts_with(p_name, 'small') AS is_small FROM part""",
)
def p11(spark, sf):
    name = F.col("p_name")
    return fx.table(spark, sf, "part").select(
        "p_partkey",
        C.remove_first(name, "l").alias("first_removed"),
        F.regexp_replace(name, "l", "").alias("all_removed"),
        F.regexp_extract(name, "small|large|red", 0).alias("word"),
        name.startswith("small").alias("is_small"),
    )


@query(
    "p12_parse_scaled_number",
    "SELECT o_orderkey, round(round(o_totalprice, 2) * 1000, 2) AS price FROM orders",
)
def p12(spark, sf):
    text = F.format_number(F.col("o_totalprice"), 2)
    return fx.table(spark, sf, "orders").select("o_orderkey", F.round(C.parse_number(text, 1000), 2).alias("price"))


@query(
    "p13_month_from_parts",
    """SELECT date_trunc('month', o_orderdate)::DATE AS month, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month_of_year,
    count(*) AS n FROM orders GROUP BY ALL""",
)
def p13(spark, sf):
    months = fx.table(spark, sf, "orders").select(
        C.to_month(F.upper(F.date_format("o_orderdate", "MMMM yyyy"))).alias("month"),
        C.month_from_parts(F.date_format("o_orderdate", "MMM"), F.year("o_orderdate")).alias("month_2"),
    )
    return (
        months.where(F.col("month") == F.col("month_2"))
        .groupBy("month", F.year("month").alias("year"), F.month("month").alias("month_of_year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p14_null_rules",
    """SELECT l_linestatus, count(nullif(l_returnflag, 'N')) AS flags, count(nullif(l_tax, 0)) AS taxed,
    round(sum(coalesce(l_discount / nullif(l_tax, 0), 0)), 4) AS ratio FROM lineitem GROUP BY l_linestatus""",
)
def p14(spark, sf):
    items = fx.table(spark, sf, "lineitem").select(
        "l_linestatus",
        C.null_if(F.col("l_returnflag"), "N").alias("flag"),
        C.zero_to_null(F.col("l_tax")).alias("tax"),
        C.nan_to(F.try_divide("l_discount", "l_tax")).alias("ratio"),
    )
    return items.groupBy("l_linestatus").agg(
        F.count("flag").alias("flags"), F.count("tax").alias("taxed"), F.round(F.sum("ratio"), 4).alias("ratio")
    )


@query("p15_incidence_rate", with_sql(f"SELECT region, year, month, diagnosis, {ROUND_RATES} FROM rated"))
def p15(spark, sf):
    panel = fx.rated_panel(spark, sf)
    return rounded(panel.select("region", "year", "month", "diagnosis", *rollup.RATE_PAIRS))


_ANIMAL = ["catt_incidence", "cam_incidence", "goat_incidence", "shp_incidence"]


@query(
    "p16_row_sum",
    with_sql(
        "SELECT region, month, diagnosis, "
        + r(" + ".join(f"coalesce({c}, 0)" for c in _ANIMAL), 6, "skipping")
        + ", "
        + r(" + ".join(_ANIMAL), 6, "propagating")
        + " FROM rated"
    ),
)
def p16(spark, sf):
    cols = [F.col(c) for c in _ANIMAL]
    return rounded(
        fx.rated_panel(spark, sf).select(
            "region",
            "month",
            "diagnosis",
            C.row_sum(cols, skip_nulls=True).alias("skipping"),
            C.row_sum(cols, skip_nulls=False).alias("propagating"),
        )
    )


_GROWTH = "(catt_pop % 7000) / 2000.0::DOUBLE"


@query(
    "p17_backcast",
    with_sql(
        f"""SELECT region, 2019 - s AS year, p AS pop FROM back""",
        [
            ("start", f"SELECT region, base_pop::DOUBLE AS p, 1 - {_GROWTH} / 100.0::DOUBLE AS f FROM regional_den"),
            ("back", "SELECT region, p, f, 0 AS s FROM start UNION ALL SELECT region, round_even(p * f, 0), f, s + 1 FROM back WHERE s < 5"),
        ],
        recursive=True,
    ),
)
def p17(spark, sf):
    base = fx.regional_denominators(spark, sf).select(
        "region", "base_pop", (F.col("catt_pop") % 7000 / F.lit(2000.0)).alias("growth")
    )
    return rows.backcast(base, "base_pop", "growth", 2019, 5)


@query(
    "p18_replace_outliers",
    """WITH m AS (SELECT round_even(avg(l_extendedprice), 0) AS all_mean,
      round_even(avg(l_quantity) FILTER (WHERE l_quantity < 40), 0) AS low_mean FROM lineitem)
    SELECT l_returnflag, l_linestatus, round(sum(CASE WHEN l_extendedprice >= 60000 THEN all_mean ELSE l_extendedprice END), 2) AS price,
      round(sum(CASE WHEN l_quantity > 40 THEN low_mean ELSE l_quantity END), 2) AS quantity
    FROM lineitem, m GROUP BY l_returnflag, l_linestatus""",
)
def p18(spark, sf):
    items = fx.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    fixed = rows.replace_outliers(items, [("l_extendedprice", 60000, ">=")])
    fixed = rows.replace_outliers(fixed, [("l_quantity", 40, ">")], mean_of="below")
    return rounded(
        fixed.groupBy("l_returnflag", "l_linestatus").agg(
            F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity")
        ),
        digits=2,
    )


@query(
    "p19_factor_codes",
    with_sql(
        """SELECT region, month, dense_rank() OVER (ORDER BY region)::INT AS region_id,
        dense_rank() OVER (PARTITION BY region ORDER BY month)::INT AS time_id FROM regional_counts"""
    ),
)
def p19(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "year", "month"], rollup.CASES)
    coded = rows.factor_codes(monthly.select("region", "month"), "region", "region_id")
    return rows.step_codes(coded, ["region"], "month", "time_id")


@query(
    "p20_format_display",
    with_sql(
        """SELECT region, format('{:,}', sum(hum_cases)::BIGINT) AS total, format('{:,}', (sum(hum_cases) FILTER (WHERE diagnosis = 'F'))::BIGINT)
        || ' (' || format('{:,.2f}', round(sum(hum_cases) FILTER (WHERE diagnosis = 'F') / sum(hum_cases)::DOUBLE * 100, 2)) || '%)' AS clinical,
        format('{:,.2f}', min(pop)::DOUBLE) || ' – ' || format('{:,.2f}', max(pop)::DOUBLE) AS pop_range FROM rated GROUP BY region"""
    ),
)
def p20(spark, sf):
    sums = fx.rated_panel(spark, sf).groupBy("region").agg(
        F.sum("hum_cases").alias("total"),
        F.sum(F.when(F.col("diagnosis") == "F", F.col("hum_cases"))).alias("clinical"),
        F.min("pop").alias("lo"),
        F.max("pop").alias("hi"),
    )
    return sums.select(
        "region",
        C.comma(F.col("total")).alias("total"),
        C.count_with_share(F.col("clinical"), F.col("total")).alias("clinical"),
        C.range_label(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))).alias("pop_range"),
    )


@query(
    "p21_holdout_split",
    with_sql(
        """SELECT region, month, idx::INT AS idx, n AS n_rows, CASE WHEN idx <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM (
        SELECT region, month, row_number() OVER (PARTITION BY region ORDER BY month) AS idx, count(*) OVER (PARTITION BY region) AS n FROM regional_counts)"""
    ),
)
def p21(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], rollup.CASES)
    return rows.holdout(monthly.select("region", "month"), ["region"], "month")


@query(
    "p22_standardise",
    with_sql(
        """SELECT region, month, """
        + r("(hum_cases - h_m) / nullif(h_s, 0)", 6, "hum_cases")
        + ", "
        + r("(catt_cases - avg(catt_cases) OVER w) / nullif(stddev_samp(catt_cases) OVER w, 0)", 6, "catt_cases")
        + """ FROM regional_counts, (SELECT avg(hum_cases) AS h_m, stddev_samp(hum_cases) AS h_s FROM regional_counts)
        WINDOW w AS (PARTITION BY region)"""
    ),
)
def p22(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], rollup.CASES)
    scaled = rows.standardise(monthly.select("region", "month", "hum_cases", "catt_cases"), ["hum_cases"])
    return rounded(rows.standardise(scaled, ["catt_cases"], ["region"]).select("region", "month", "hum_cases", "catt_cases"))


@query(
    "p23_row_index",
    with_sql("SELECT region, month, row_number() OVER (PARTITION BY region ORDER BY month)::INT AS idx FROM regional_counts"),
)
def p23(spark, sf):
    monthly = rollup.sum_by(fx.base_panel(spark, sf), ["region", "month"], rollup.CASES)
    return rows.row_index(monthly.select("region", "month"), ["region"], "month")


