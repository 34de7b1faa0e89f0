"""Folders for intermediate files that driver and executors share.

Each application has a folder of its own below ``spark.checkpoint.dir``. Results are lazy, so
a query can't delete what it reads; the folder goes when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_registered: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder of a local master, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def application_folder(spark: SparkSession, kind: str) -> str:
    """The application's folder of some kind, which is deleted when its driver ends."""
    path = f"{shared_folder(spark)}/{kind}/{spark.sparkContext.applicationId}"
    if path not in _registered:
        _registered.add(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path in the application's folder."""
    return f"{application_folder(spark, 'scratch')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read back, so that it is computed once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
