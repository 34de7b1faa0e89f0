"""Positions of lines in text that lies in many files and splits.

The lines of a folder are numbered from 0 on by file name and byte offset, in two levels:
lines within a split (a task reads it from front to back), splits by their counts. What is
ordered in one place is the list of splits and files, as long as a file listing, never the
lines. A folder that :func:`tidemark.sources.sinks.ordered_lines` wrote comes back in the
order it was written in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import staged

#: Splits that a broadcast may list (some hundred bytes each).
BROADCAST_SPLITS = 200_000


def _lines(spark: SparkSession, paths: str | list[str], blank: bool, sep: str | None = None) -> DataFrame:
    """(value, _file, _block, _at); _at ascends by one from line to line of a split."""
    lines = spark.read.text(paths, lineSep=sep).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    if not blank:
        lines = lines.filter(~F.col("value").rlike(r"^\s*$"))
    return lines.withColumn("_at", F.monotonically_increasing_id())


def file_counts(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """Staged (file, n, before): lines of each file and of those before it, by file name."""
    counts = _lines(spark, path, blank).groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n"))
    return staged(counts.withColumn("before", F.sum("n").over(Window.orderBy("file")) - F.col("n")))


def _numbered(lines: DataFrame, first: int = 0) -> DataFrame:
    """(position, value, first, last) of ``lines``: first and last of a file."""
    splits = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    within = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    splits = staged(splits.withColumn("_within", within))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n"))
    files = files.select("_file", F.col("_n").alias("_of"), (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    starts = splits.join(files, "_file").select("_file", "_block", (F.col("_before") + first).alias("_start"), (F.col("_before") + F.col("_within") - F.col("_first") + first).alias("_shift"), "_of")
    starts = F.broadcast(starts) if splits.count() <= BROADCAST_SPLITS else starts
    position = F.col("_at") + F.col("_shift")
    place = position - F.col("_start")
    return lines.join(starts, ["_file", "_block"]).select(position.alias("position"), "value", (place == 0).alias("first"), (place == F.col("_of") - 1).alias("last"))


def numbered_lines(spark: SparkSession, path: str | list[str], blank: bool = False, first: int = 0) -> DataFrame:
    """(position, value) of all lines, from ``first`` on. blank: blank lines count and are kept."""
    return _numbered(_lines(spark, path, blank), first).select("position", "value")


def numbered_pieces(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(position, value, first, last) of what ``sep`` separates, blank or not; a long line is read in splits too."""
    return _numbered(_lines(spark, path, True, sep))


def slice_lines(spark: SparkSession, path: str, start: int = 0, end: int | None = None, blank: bool = False) -> DataFrame:
    """(position, value) of the lines [start, end): only files that hold some of them are read for it."""
    files = file_counts(spark, path, blank).filter(F.col("before") + F.col("n") > start)
    files = files.filter(F.col("before") < end) if end is not None else files
    held = files.orderBy("file").collect()
    if not held:
        return spark.createDataFrame([], "position long, value string")
    lines = numbered_lines(spark, [r.file for r in held], blank, held[0].before).filter(F.col("position") >= start)
    return lines.filter(F.col("position") < end) if end is not None else lines


def in_source_order(rows: DataFrame) -> DataFrame:
    """Rows with a position, back in the order of their source."""
    return rows.orderBy("position")
