"""Lineage cuts for loops over plans, and the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all runs in one process, a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="textlake-"))
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the cluster's shared checkpoint folder, so that later plans don't compute them again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the shuffle and checkpoint files deleted that no plan refers to any more.

    Spark deletes them when the driver's heap is collected, which may be long after; until then loops over plans add to them.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder that this engine has made, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
