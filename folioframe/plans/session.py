"""Cutting lineage in the shared folder that the session names."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. One of this machine is set where none is named and all runs on this machine (tests)."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not folder and not context.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="folioframe-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
        context.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        atexit.register(_remove_checkpoints, spark)
    return folder


def _remove_checkpoints(spark: SparkSession) -> None:
    """Checkpoints of this session that are still there when the program ends; nothing can read them any more."""
    if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        remove(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, whose files Spark removes once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
