"""The folder that driver and executors share, and tables that are written there for a session's time."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and the session is local. Raises on a cluster
    without it: executors would write to disks of their own, and rows would be lost."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stagelens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other has; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/stagelens/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder. For what is small but comes of much: Spark then knows its size."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes what nothing reads any more."""
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended before the interpreter
        pass
