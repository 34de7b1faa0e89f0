"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession


def episodes(rows: DataFrame, path: str) -> None:
    """JSON lines in the order of ``rows``, replacing what was there.

    Tasks write in parallel: the numbers of the part files carry the order, which
    ``positions.numbered_lines`` reads back.
    """
    rows.write.mode("overwrite").json(path)


def ordered_lines(rows: DataFrame, keys: list[Column | str], path: str, parts: int | None = None) -> None:
    """JSON lines in order of ``keys``: each task sorts and writes a range of them, none holds the whole order."""
    ranges = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    episodes(ranges.sortWithinPartitions(*keys), path)


def append_records(rows: DataFrame, path: str) -> None:
    """Records of finished rollouts; a task's rows appear together or not at all."""
    rows.write.mode("append").json(path)


def sample(chosen: DataFrame, selection: DataFrame, stats: DataFrame, folder: str) -> None:
    """The sample, its selection table and its statistics side by side."""
    episodes(chosen, f"{folder}/sample")
    episodes(selection, f"{folder}/selection")
    stats.coalesce(1).write.mode("overwrite").json(f"{folder}/build_stats")


def metric_table(metrics: DataFrame, path: str, step: int) -> None:
    from pyspark.sql import functions as F

    metrics.withColumn("step", F.lit(step)).write.mode("append").parquet(path)


def manifest(spark: SparkSession, config: dict, prompts: dict[str, str], path: str) -> None:
    """Configuration and prompt texts of a run, as one JSON document."""
    text = json.dumps({"config": config, "prompts": prompts}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
