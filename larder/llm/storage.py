"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    The folder is the session's spark.checkpoint.dir.  Only where that is unset and the session runs on this machine alone, as in
    tests, a folder of this machine is taken; on a cluster other executors couldn't read it, so there it must be set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver notice which shuffles are no longer in use: their files go once it collects its garbage.

    Spark has no call that frees a finished plan's shuffle files; without a collection those of all steps stay on the executors' disks
    until the driver's heap happens to fill.  The virtual machine is reached as Spark's own Python code reaches it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
