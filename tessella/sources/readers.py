"""Readers: filtered CSV, fixed width, newest of several files, and what is still missing from a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_fixed_width(df: DataFrame, line: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    """(name, start from 1, length, type); blanks around a value are dropped, what can't be cast is null."""
    return df.select(*[F.trim(F.substring(line, start, size)).try_cast(kind).alias(name) for name, start, size, kind in fields])


def read_fixed_width(spark: SparkSession, path: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    return parse_fixed_width(spark.read.text(path), "value", fields)


def read_csv(spark: SparkSession, path: str, schema: str, column: str, wanted: list) -> DataFrame:
    """Rows whose ``column`` is among ``wanted``; NaN becomes null."""
    df = spark.read.csv(path, schema=schema, header=True).where(F.col(column).isin(wanted))
    return df.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def newest(spark: SparkSession, pattern: str, format: str = "parquet") -> DataFrame:
    """The rows of the file changed last among those that match."""
    df = spark.read.format(format).load(pattern).select("*", F.col("_metadata.file_modification_time").alias("_t"), F.col("_metadata.file_path").alias("_f"))
    last = df.agg(F.max(F.struct("_t", "_f")).alias("x")).select("x.*")
    return df.join(F.broadcast(last), ["_t", "_f"], "left_semi").drop("_t", "_f")


def append_missing(store: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``store`` with those rows of ``source`` whose keys it lacks."""
    return store.unionByName(source.join(store.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
