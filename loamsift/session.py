"""What a session needs before Python workers can use this package."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)


#: A table that is read in fewer parts than there are cores is spread over them from this size on.
SPREAD_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. One that lies in a file or two that cannot be split would keep one core busy; its rows are dealt out first. Tables of many files are left as they are."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if cores > 1 and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SPREAD_BYTES and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


@functools.cache
def local_folder() -> str:
    """A folder of this machine, for tests and single machines; it goes with the process."""
    folder = tempfile.mkdtemp(prefix="loamsift-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or on this machine where that is unset and all is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{local_folder()}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
