"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.scratch import application_folder


#: Bytes of an Arrow batch while a table is staged: rows hold whole texts, and a worker copies a batch some times.
BATCH_BYTES = 16 << 20


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind and use small Arrow batches; the session's settings are put back."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", batch: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stage(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. Nothing
    reads the shuffles of the write again, so they are removed with it. What is not released
    before is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{application_folder(spark, 'staged')}/{uuid.uuid4().hex}"
    with staging(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete staged tables that nothing lazy depends on any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            jvm = spark.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/staged/" in folder.toString():
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def has_ids(docs: DataFrame) -> bool:
    """Are the ids (doc_id) whole numbers, distinct and not null?"""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return False
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()


def with_rid(docs: DataFrame, plain: bool | None = None) -> DataFrame:
    """Adds rid, a 64-bit name of each row of (doc_id, text).

    It is the id itself where ids are whole numbers, distinct and not null, so no two rows
    can be taken for one another; else a hash of id and text, by which repeated rows share
    a name.
    """
    plain = has_ids(docs) if plain is None else plain
    return docs.withColumn("rid", F.col("doc_id").cast("long") if plain else F.xxhash64("doc_id", "text"))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of ids that a broadcast may hold: some tens of MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of ids, marked for broadcast if it has ``rows`` rows at most; else left to a shuffle join."""
    df = stage(df)
    return F.broadcast(df) if df.count() <= rows else df
