"""Sinks: published tables and named bundles of tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def publish(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    *,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write a result table; every task writes its own files. Delimited text has a header, quotes doubled, NA for null."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write the partitions that ``df`` has rows for, in place of those of the same values; the files of others stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def save_bundle(tables: dict[str, DataFrame], directory: str, mode: str = "overwrite") -> None:
    """One Parquet directory per name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{directory}/{name}")


def load_bundle(
    spark: SparkSession, directory: str, names: Iterable[str], *, register: bool = True
) -> dict[str, DataFrame]:
    """The named tables, each also a temporary view unless ``register`` is off."""
    tables = {name: spark.read.parquet(f"{directory}/{name}") for name in names}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables
