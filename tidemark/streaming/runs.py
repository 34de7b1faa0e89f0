"""Incremental evaluation with Structured Streaming.

The reference behaviour is a batch append log with a resume set; ``operators.evaluation``
has that. Here new result files are scored as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluation import scorecard
from ..operators.metrics import merge_counters
from ..operators.retrieval import search
from ..sources.files import valid_json


def record_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Records of the files that arrive in a folder; malformed lines are dropped, as by the batch reader."""
    return valid_json(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), schema)


def running_scorecard(records: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """The scorecard over all records so far, kept as an in-memory table."""
    card = scorecard(records, ("run_id",))
    return card.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()


def drain_counters(parts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's counters, summed by name, written under its batch number (rerun-safe)."""

    def write(batch: DataFrame, number: int) -> None:
        merge_counters(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return parts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stepwise_search(steps: DataFrame, articles: DataFrame, path: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Hits of forecast steps (query_id, vector, start, cutoff) as they arrive.

    Each step sees the articles from its start to its own date, so an event's window
    expands step by step. Hits are written under their batch number (rerun-safe).
    """

    def write(batch: DataFrame, number: int) -> None:
        search(articles, batch, k=k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return steps.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
