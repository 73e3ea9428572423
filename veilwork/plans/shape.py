"""Partitioning helpers shared by the plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


MOST_SPREAD = 32  # partitions of a scan up to which its rows may be dealt anew


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small table, which often is one row group that one task would read alone, one partition per core.

    A scan of ``MOST_SPREAD`` partitions or more (4 GB at Spark's own size of a partition) is left as it is, so the texts
    of a large table are never shuffled, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, MOST_SPREAD):
        return df
    return df.repartition(cores, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Without that setting only a local session, whose executors are the driver itself, gets a folder of its own; a
    cluster session is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veilwork-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once what several branches of a plan read, in the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
