"""State kept by key in partitions: a batch rewrites only the partitions that its keys fall into, and a ledger remembers which batches are in.

root/state holds the rows, partitioned by the hash of the key; root/ledger one line for each batch. A batch goes into the state first and into the ledger then: if a job ends
between the two, the batch comes again, so `merge` must give the same for rows that are in already, as upserts and distinct unions do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.checkpoints import materialized

#: Partitions of a state; fixed once it is made, as keys move with it.
PARTITIONS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_state(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of a state, none where there is no state yet."""
    if not _exists(spark, f"{root}/state"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, __part int").parquet(f"{root}/state").drop("__part")


def batches(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, rows) of the ledger."""
    if not _exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], "batch_id string, rows long")
    return spark.read.schema("batch_id string, rows long").parquet(f"{root}/ledger")


def apply_batch(root: str, rows: DataFrame, batch_id: str | int, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str, key: str = "article_id", partitions: int = PARTITIONS) -> bool:
    """Merges rows into the state as merge(state, rows), read and written in the partitions of their keys alone; False for a batch that the ledger has.
    schema: the columns of the state. merge must keep the keys of both sides."""
    spark = rows.sparkSession
    if batches(spark, root).where(F.col("batch_id") == str(batch_id)).count():
        return False
    names = [f.split()[0] for f in schema.split(",")]
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(partitions)).cast("int")
    new = materialized(rows.withColumn("__part", part))
    touched = sorted(r[0] for r in new.select("__part").distinct().collect())  # at most `partitions` numbers
    if touched:
        old = read_state(spark, root, schema) if not _exists(spark, f"{root}/state") else spark.read.schema(f"{schema}, __part int").parquet(f"{root}/state").where(F.col("__part").isin(*touched)).drop("__part")
        merged = materialized(merge(old, new.drop("__part")).select(*names).withColumn("__part", part))  # before its own partitions are replaced
        merged.repartition(len(touched), "__part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__part").parquet(f"{root}/state")
    spark.createDataFrame([(str(batch_id), new.count())], "batch_id string, rows long").coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    return True
