"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_seen: set[str] = set()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file or folder; the folders above its new place are made."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{path} could not be moved to {to}")


def folder(spark: SparkSession) -> str:
    """This application's folder for files under ``spark.checkpoint.dir``, deleted when the process ends.
    A local session without that setting gets a temporary one; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/files-{spark.sparkContext.applicationId}"
    if path not in _seen:
        _seen.add(path)
        atexit.register(_end, spark, path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written to this application's folder and read back: lineage is cut, any executor can read it, and
    its size is known to the planner."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _end(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session is gone: the folder is named after the application for others to delete
        pass
