"""Cutting lineage between rounds of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for the driver and all executors; only a session of one
    machine may lack one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or "cluster" in master:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="loom-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    # a checkpoint computes its rows twice, once to write them, unless they are held meanwhile
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint()
    finally:
        df.unpersist()
