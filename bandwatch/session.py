"""Spark session helpers for local runs, tests and benchmarks."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str | None = None, app: str = "bandwatch") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.aggregatePushdown", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a session
    whose tasks run inside this process (tests) may do without: it gets a
    temporary folder. Anywhere else an unset folder is an error, since executors
    do not see each other's local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that is no longer read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written_once(df, purpose: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and lets several consumers share one computation; the files
    survive the loss of executors, which cached blocks do not.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
