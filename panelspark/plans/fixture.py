"""The surveillance panel on the order tables.

Orders are the case reports: nation = region, order month = month, order status =
diagnosis, order priority = series. Denominators come from customers and suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.functions.vocab import SERIES
from panelspark.operators.joins import attach_scalars, join_rolled_denominator
from panelspark.operators.rollup import CASES, POPS, RATE_PAIRS, sum_by
from panelspark.operators.rows import rate_columns

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SERIES_OF = dict(zip(PRIORITIES, SERIES))
STATUSES = {"F": "clinical", "O": "lab", "P": "post_mortem"}

_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per report: region key, month, year, diagnosis, series label."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.trunc("o_orderdate", "month").alias("month"),
        F.col("o_orderstatus").alias("diagnosis"),
        "o_orderpriority",
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        "n_nationkey", "month", "diagnosis", "o_orderpriority"
    )


def base_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, year, month, diagnosis) with a case count per series.

    Reports are counted by nation key before the names are joined, so the join sees
    panel rows and not reports.
    """
    counts = (
        reports(spark, sf_dir)
        .groupBy("n_nationkey", "month", "diagnosis")
        .agg(*[F.count_if(F.col("o_orderpriority") == p).alias(f"{s}_cases") for p, s in SERIES_OF.items()])
    )
    return counts.join(_nation_names(spark, sf_dir), "n_nationkey").select(
        "region", F.year("month").alias("year"), "month", "diagnosis", *[f"{s}_cases" for s in SERIES]
    )


def long_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, year, month, diagnosis, series, cases)."""
    counts = (
        reports(spark, sf_dir)
        .groupBy("n_nationkey", "month", "diagnosis", F.col("o_orderpriority").alias("series"))
        .agg(F.count(F.lit(1)).alias("cases"))
    )
    return counts.join(_nation_names(spark, sf_dir), "n_nationkey").select(
        "region", F.year("month").alias("year"), "month", "diagnosis", "series", "cases"
    )


def regional_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, base_pop and four animal populations); some regions have no camels."""
    people = (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(
            (F.count(F.lit(1)) * 1000).alias("base_pop"),
            *[
                (F.count_if(F.col("c_mktsegment") == segment) * 1000).alias(f"{animal}_pop")
                for segment, animal in (("BUILDING", "catt"), ("HOUSEHOLD", "goat"), ("MACHINERY", "sheep"))
            ],
        )
    )
    camels = (
        table(spark, sf_dir, "supplier")
        .groupBy(F.col("s_nationkey").alias("n_nationkey"))
        .agg((F.count_if(F.col("s_acctbal") < 3000) * 1000).alias("cam_pop"))
    )
    return (
        people.join(camels, "n_nationkey", "left")
        .join(_nation_names(spark, sf_dir), "n_nationkey")
        .select(
            "region", "base_pop", "catt_pop", "goat_pop", "sheep_pop", F.coalesce("cam_pop", F.lit(0)).alias("cam_pop")
        )
    )


def denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, year) for the years of the reports: static animals, people growing by 2 % of the first year's a year."""
    year = F.year("o_orderdate")
    span = attach_scalars(
        regional_denominators(spark, sf_dir), table(spark, sf_dir, "orders"), {"_first": F.min(year), "_last": F.max(year)}
    )
    spread = span.withColumn("year", F.explode(F.sequence("_first", "_last")))
    grown = F.col("base_pop") * (F.lit(100) + (F.col("year") - F.col("_first")) * 2) / F.lit(100)
    return spread.select(
        "region", "year", "catt_pop", "goat_pop", "sheep_pop", "cam_pop", F.bround(grown, 0).cast("long").alias("pop")
    )


def rated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base panel with denominators and rates."""
    joined = base_panel(spark, sf_dir).join(denominators(spark, sf_dir), ["region", "year"])
    return rate_columns(joined, RATE_PAIRS)


def regional_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, month): the panel summed over diagnoses, with rates."""
    monthly = sum_by(base_panel(spark, sf_dir), ["region", "year", "month"], CASES)
    return rate_columns(monthly.join(denominators(spark, sf_dir), ["region", "year"]), RATE_PAIRS)


def national_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month): the national panel with rates."""
    monthly = sum_by(base_panel(spark, sf_dir), ["year", "month"], CASES)
    return rate_columns(
        join_rolled_denominator(monthly, denominators(spark, sf_dir), ["year"], POPS), RATE_PAIRS
    )
