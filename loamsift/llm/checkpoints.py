"""Cutting lineage in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import local_folder


def use_checkpoints(spark: SparkSession) -> None:
    """Take the folder named by ``spark.checkpoint.dir``; only where it is unset (tests, one machine) make one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = local_folder()
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
