"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV (with header).  CSV needs a schema at scale: inferring one reads the file twice."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, header=True, inferSchema=schema is None) if kind == "csv" else reader.format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A table that may be left out (a baseline, a test set)."""
    return read(spark, path) if path else None
