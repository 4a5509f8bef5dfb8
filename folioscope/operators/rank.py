"""Ranks without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.checkpoints import materialized


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds 1..n by `order`, which should end in a unique column.

    Rows are range-partitioned and sorted by the order, so partitions follow each other, and written with their place within their partition;
    to that the number of rows in the partitions before is added, from a table of one row for each partition. Both writes run at once, when this is called:
    range partitioning samples its input first, so that the input is written before it, and what leads to it runs once."""
    place = F.monotonically_increasing_id()  # the partition above 33 bits, the place within it below
    placed = materialized(materialized(df).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    ranked = placed.withColumn("__part", part).join(F.broadcast(before), "__part")  # as many rows as partitions
    return ranked.withColumn(name, F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1).drop("__part", "__at", "__before")


def padded_id(prefix: str, number: Column | str, width: int) -> Column:
    """The number after a prefix, padded with zeros to at least `width` digits."""
    at = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(at) >= width, at).otherwise(F.lpad(at, width, "0")))


def batch_id(rank: Column | str, size: int = 100, prefix: str = "R") -> Column:
    """R001 for the first `size` ranks, and so on."""
    at = F.col(rank) if isinstance(rank, str) else rank
    return padded_id(prefix, ((at - 1) / size).cast("long") + F.lit(1).cast("long"), 3) if size else F.lit("")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by `order`."""
    return top_by(df, keys, order, 1).drop("__n")


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by `order`, with __n from 1; Spark keeps n rows a key before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, width: int = 3) -> DataFrame:
    """Adds a number from 1 within each key as text, padded with zeros."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.when(F.length(at.cast("string")) >= width, at.cast("string")).otherwise(F.lpad(at.cast("string"), width, "0")))
