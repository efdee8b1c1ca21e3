"""Readers: delimited text with declared schemas, dimension tables, literal rows."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_names(names: Sequence[str]) -> list[str]:
    """Syntactic, unique column names: odd characters to dots, ``X`` before a bad start."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for raw in names:
        name = re.sub(r"[^0-9A-Za-z_.]", ".", raw.strip())
        if not name or not re.match(r"[A-Za-z.]", name) or re.match(r"\.\d", name):
            name = "X" + name
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(name if count == 0 else f"{name}.{count}")
    return out


def _is_unnamed(name: str | None) -> bool:
    return name is None or name.strip() == "" or re.fullmatch(r"_c\d+", name) is not None


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    *,
    null: str = "NA",
    header_row: int = 0,
    drop_unnamed: bool = True,
    fmt: str = "csv",
    syntactic_names: bool = False,
    bad_cells: str | None = None,
) -> DataFrame:
    """Read a headered delimited file (or Parquet).

    ``schema`` gives names and types; columns are matched by their header, in any
    order, and others are left out. Without it every column is text, so no pass over
    the data is spent on inference. A file of the path whose header differs from the
    first one's fails. A cell that its type can't hold fails the read, or becomes null
    and is counted in the column that ``bad_cells`` names. ``header_row=1`` takes the
    header from the first data row. Index columns without a name are dropped.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.toDF(*clean_names(df.columns)) if syntactic_names else df

    reader = spark.read.option("header", True).option("nullValue", null).option("escape", '"')
    reader = reader.option("mode", "FAILFAST").option("enforceSchema", False)
    # only the header lines come to the driver
    lines = spark.read.text(path).head(header_row + 1)
    top = next(csv.reader([lines[0].value])) if lines else []
    names = next(csv.reader([lines[header_row].value])) if len(lines) > header_row else []
    if header_row:
        fields = [T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(names)]
        df = reader.option("enforceSchema", True).schema(T.StructType(fields)).csv(path)
        same = [F.col(f"`{f.name}`").eqNullSafe(F.lit(n or None)) for f, n in zip(fields, names)]
        df = df.where(~reduce(lambda a, b: a & b, same))
    else:
        df = reader.schema(T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(top)])).csv(path)
    if drop_unnamed:
        df = df.drop(*[c for c in df.columns if _is_unnamed(c)])
    if schema is not None:
        typed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        missing = [f.name for f in typed if f.name not in df.columns]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        cells = {f.name: F.col(f"`{f.name}`") for f in typed}
        if bad_cells is None:
            df = df.select(*[cells[f.name].cast(f.dataType).alias(f.name) for f in typed])
        else:
            lost = [(cells[f.name].isNotNull() & cells[f.name].try_cast(f.dataType).isNull()).cast("int") for f in typed]
            df = df.select(*[cells[f.name].try_cast(f.dataType).alias(f.name) for f in typed], reduce(lambda a, b: a + b, lost).alias(bad_cells))
    return df.toDF(*clean_names(df.columns)) if syntactic_names else df


def region_dim(spark: SparkSession, path: str, name: str = "NAME_1", alias: str = "region") -> DataFrame:
    """Region names of a map layer's attribute table; the scan reads that one column."""
    return spark.read.parquet(path).select(F.col(name).alias(alias))


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows given in the program text."""
    return spark.createDataFrame(list(rows), schema)
