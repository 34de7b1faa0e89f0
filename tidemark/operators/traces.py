"""Conversation traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_think


def turns(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Adds turn to messages (key, pos, role, tool_result): assistants count from 1, tool results share the count, other users have 0."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(so_far)
    shared = (F.col("role") == "assistant") | F.coalesce(F.col("tool_result"), F.lit(False))
    return messages.filter(F.col("role").isin("assistant", "user")).withColumn("turn", F.when(shared, count).otherwise(0))


def flatten_message(content: Column) -> Column:
    """Text (joined by newlines), tool uses and tool results of a message's blocks."""
    has = lambda name: F.filter(content, lambda b: b[name].isNotNull())
    pieces = lambda r: F.array_join(F.filter(F.transform(r["content"], lambda c: c["text"]), lambda t: t.isNotNull()), "\n")
    return F.struct(
        F.array_join(F.transform(has("text"), lambda b: b["text"]), "\n").alias("text"),
        F.transform(has("toolUse"), lambda b: F.struct(F.coalesce(b["toolUse"]["toolUseId"], F.lit("")).alias("id"), b["toolUse"]["name"].alias("name"), b["toolUse"]["input"].alias("input"))).alias("tool_uses"),
        F.transform(
            has("toolResult"),
            lambda b: F.struct(F.coalesce(b["toolResult"]["toolUseId"], F.lit("")).alias("id"), F.coalesce(b["toolResult"]["status"], F.lit("success")).alias("status"), F.coalesce(pieces(b["toolResult"]), F.lit("")).alias("text")),
        ).alias("tool_results"),
    )


#: Message blocks as they are stored; a block has one of the three.
BLOCKS = """array<struct<text: string, toolUse: struct<toolUseId: string, name: string, input: map<string, string>>,
toolResult: struct<toolUseId: string, status: string, content: array<struct<text: string>>>>>"""


def full_trace(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, pos, role, turn, text, tool_uses, tool_results) from messages (key, pos, role, content of :data:`BLOCKS`)."""
    flat = messages.withColumn("m", flatten_message(F.coalesce("content", F.array().cast(BLOCKS))))
    rows = turns(flat.withColumn("tool_result", F.size("m.tool_results") > 0), key)
    return rows.select(key, "pos", "role", "turn", "m.text", "m.tool_uses", "m.tool_results")


def final_response(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, response): the last message's text past any reasoning, null unless an assistant wrote it."""
    last = messages.groupBy(key).agg(F.max_by(F.struct("role", "text"), "pos").alias("m"))
    return last.select(key, F.when(F.col("m.role") == "assistant", strip_think("m.text")).alias("response"))


def concatenated(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): all messages of a key in order of pos."""
    return messages.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def retry_counts(log: DataFrame, column: str = "message") -> DataFrame:
    """(counter, n): failed and exhausted requests, and error types, from log lines."""
    text = F.col(column)
    lines = log.filter(text.contains("request failed")).select(text.alias("m"))
    exhausted = F.col("m").contains("after") & F.col("m").contains("attempts")
    kind = F.regexp_extract("m", r"request failed.*?: (\w+):", 1)
    counters = F.array(F.when(exhausted, "n_exhausted").otherwise("n_failed_attempts"), F.when(kind != "", F.concat(F.lit("by_type/"), kind)))
    each = lines.select(F.explode(counters).alias("counter")).filter("counter is not null")
    return each.groupBy("counter").agg(F.count("*").alias("n"))
