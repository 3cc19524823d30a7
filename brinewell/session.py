"""Session set-up and the one place that decides where shared files live."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brinewell")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def file_system(spark: SparkSession, path: str):
    """The JVM's file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path for plain file calls, or None where the file system that it names, or the default one, is no mounted disk."""
    fs, at = file_system(spark, path)
    whole = fs.makeQualified(at).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory below the folder that all executors share (spark.checkpoint.dir); it goes when the driver's JVM ends.

    Only where that setting is unset, as in tests on one machine, a local temporary folder is set in its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = os.path.join(tempfile.gettempdir(), "brinewell-shared")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def checkpointed(df):
    """df with its lineage cut by files in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint(eager=True)
