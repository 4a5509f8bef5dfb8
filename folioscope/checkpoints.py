"""Tables written to the shared checkpoint folder: what reads them doesn't compute them again, also after a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local folder for a session on one machine, as in tests; an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialized(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
