"""Delimited tables of strings, packets by batch, optional inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A delimited file with a header, all strings, missing as empty; a missing path is an empty table with these columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    try:
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, schema=schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df.na.fill("")


def write_strings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Arrays joined by `|`, everything as strings, with a header."""
    flat = [F.array_join(f.name, "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields]
    df.select(*flat).na.fill("").write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_packets(df: DataFrame, path: str, by: str = "batch_id", mode: str = "overwrite") -> None:
    """One folder for each batch or split group."""
    df.repartition(by).write.mode(mode).partitionBy(by).parquet(path)


def optional(spark: SparkSession, df: DataFrame | None, columns: dict[str, str]) -> DataFrame:
    """df, or an empty table with these columns (name: type)."""
    return df if df is not None else spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))
