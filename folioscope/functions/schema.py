"""Fixed column lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns (name: type), in order; missing ones as nulls of their type."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def with_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the missing ones of these columns as empty strings."""
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})
