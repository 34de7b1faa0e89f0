"""Sharding by minimax contiguous partition.

Rows with equal text are an atomic group. Groups are put in order (largest first,
then by digest of the text), and the smallest capacity is sought by binary search for
which greedy packing, in order, needs no more than the given number of shards; the
cuts of that packing are the shards' borders.

Prefix sums are two-level over range-partitioned rows, so a group of any size spreads
over partitions. The search runs on the driver over a bounded set of group borders:
first one border for each of ``SUMMARY`` stretches of the prefix sum, which brackets
the answer, then all borders inside the brackets, with finer stretches in between as
long as those are too many. Where brackets do not narrow, ``PROBES`` capacities at a time
are packed by passes over all borders. The result is the exact minimum either way, and the
driver never holds more than that many numbers.

The join of rows with their group's size is one of plain staged tables, in which Spark
splits a group that exceeds a partition. Null text is a group of its own with size 1 a
row. Repeated rows are rows. Texts of any length are handled whole. The shards after the
last group are empty; an empty table gives an empty result. ``text_rows`` ignores extra
columns; ``assign`` keeps those that its rows have, except that the names ``_weight``,
``_group``, ``_row``, ``_sum``, ``_part``, ``_start``, ``_index``, ``shard`` and ``slot`` are its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import shuffle_width, stage

SUMMARY, PROBES = 50_000, 1000


def pack(ends: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """Greedy cuts (prefix sums) over group ends, or None if it takes more shards."""
    cuts, at = [], 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, at + capacity, "right")) - 1
        if k < 0 or ends[k] <= at:
            break
        at = int(ends[k])
        cuts.append(at)
        if at == ends[-1]:
            return np.array(cuts)
    return None


def smallest_capacity(ends: np.ndarray, shards: int, least: int) -> int:
    """Binary search for the least capacity that packs into ``shards``."""
    low, high = least, int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if pack(ends, middle, shards) is not None:
            high = middle
        else:
            low = middle + 1
    return low


def _brackets(ends: np.ndarray, low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """Where the cuts of any capacity in [low, high] fall, given some of the borders."""
    out, a, b = [], 0, 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, a + low, "right")) - 1
        a = max(a, int(ends[k]) if k >= 0 else 0)
        b = min(b + high, int(ends[-1]))
        out.append((a, b))
    return out


def _farthest(reach: np.ndarray):
    """For each number of ``reach`` the greatest end of the task up to it."""

    def run(batches):
        best = np.full(len(reach), -1, np.int64)
        for batch in batches:
            ends = np.sort(batch.column("end").to_numpy())
            at = np.searchsorted(ends, reach, "right") - 1
            best = np.where(at >= 0, np.maximum(best, ends[np.maximum(at, 0)]) if len(ends) else best, best)
        some = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], names=["i", "end"])

    return run


def packed_by_passes(ends: DataFrame, capacities: np.ndarray, shards: int) -> np.ndarray:
    """Greedy cuts for each capacity, one row a shard: each shard is one pass over ``ends``."""
    at, cuts = np.zeros(len(capacities), np.int64), []
    for _ in range(shards):
        found = ends.select("end").mapInArrow(_farthest(at + capacities), "i long, end long").groupBy("i").agg(F.max("end").alias("end")).collect()
        after = at.copy()
        for r in found:
            after[r.i] = max(at[r.i], r.end)
        at = after
        cuts.append(at)
    return np.array(cuts)


def probed_cuts(ends: DataFrame, shards: int, low: int, high: int, total: int, probes: int = PROBES) -> tuple[int, np.ndarray]:
    """The least capacity in [low, high] (high is enough), by passes that pack many capacities at a time."""
    while True:
        tried = np.unique(np.linspace(low, high, probes).astype(np.int64))
        cuts = packed_by_passes(ends, tried, shards)
        first = int(np.flatnonzero(cuts[-1] == total)[0])
        if first == 0 or tried[first] == tried[first - 1] + 1:
            return int(tried[first]), np.unique(cuts[:, first])
        low, high = int(tried[first - 1]) + 1, int(tried[first])


def minimax_cuts(ends: DataFrame, shards: int, largest: int, total: int, summary: int = SUMMARY) -> tuple[int, np.ndarray]:
    """Capacity and cuts over ``ends`` (column ``end``: prefix sums after each group)."""
    least = max(largest, -(-total // shards))
    inside, width = F.lit(True), total
    while True:
        some = ends.filter(inside)
        step = max(1, width // summary) if some.count() > summary else 1  # few borders: all at once
        if step > 1:
            some = some.groupBy(F.floor(F.col("end") / step)).agg(F.max("end").alias("end"))
        known = np.unique(np.array([r[0] for r in some.select("end").collect()] + [total], np.int64))
        capacity = smallest_capacity(known, shards, least)
        if step == 1:  # all borders that a cut can have: a capacity that was found among some of them has other cuts
            return capacity, pack(known, capacity, shards)
        spans: list[list[int]] = []
        for a, b in _brackets(known, least, capacity, shards):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | F.col("end").between(a, b)
        narrower = sum(b - a + 1 for a, b in spans)
        if narrower >= width:  # brackets do not help
            return probed_cuts(ends, shards, least, capacity, total)
        width = narrower


def _running(batches):
    """Adds the size of the partition's rows so far; state passes from batch to batch."""
    so_far = 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        upto = so_far + np.cumsum(sizes)
        so_far = int(upto[-1]) if len(upto) else so_far
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - sizes, pa.int64())], names=[*batch.schema.names, "_sum"])


def assign(rows: DataFrame, shards: int = 16) -> DataFrame:
    """``rows`` (needs size and group; keep it narrow) with shard and slot added.

    slot numbers the rows of a shard from 0 without gaps.
    """
    spark = rows.sparkSession
    rows = stage(rows)
    names = rows.columns
    totals = stage(rows.groupBy("group").agg(F.sum("size").alias("_weight")))  # staged: a join of plain scans can split a hot group
    ordered = rows.join(totals.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group"))).drop("_group")
    keys = [F.col("_weight").desc(), F.col("group"), F.col("doc_id")]
    ordered = ordered.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn("_row", F.monotonically_increasing_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", _sum long"
    ordered = stage(ordered.mapInArrow(_running, schema)).withColumn("_part", F.shiftright("_row", 33))
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("size").alias("_s"))
    upto = Window.orderBy("_part")
    parts = parts.select("_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_rows_before"), (F.sum("_s").over(upto) - F.col("_s")).alias("_size_before"))
    placed = ordered.join(parts, "_part").select(
        *names,
        (F.col("_size_before") + F.col("_sum")).alias("_start"),
        (F.col("_rows_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).alias("_index"),
    )
    groups = placed.groupBy("group").agg(F.min("_start").alias("begin"), F.max(F.col("_start") + F.col("size")).alias("end"))
    groups = stage(groups)
    total, largest = groups.agg(F.max("end"), F.max(F.col("end") - F.col("begin"))).first()
    if total is None:
        return placed.select(*names, F.lit(0).alias("shard"), F.col("_index").alias("slot"))
    _, cuts = minimax_cuts(groups, shards, largest, total)
    inner = [int(c) for c in cuts[:-1]]
    shard = sum([(F.col("_start") >= c).cast("int") for c in inner], F.lit(0))
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    starts = {r.shard: r._first for r in first.collect()}
    base = F.lit(0).cast("long")
    for k in sorted(starts):
        base = F.when(F.col("shard") == k, F.lit(starts[k])).otherwise(base)
    return placed.select(*names, "shard", (F.col("_index") - base).alias("slot"))


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes and 1), group (digest of the text) and text_crc32 of each row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return docs.select("doc_id", size.alias("size"), F.md5("text").alias("group"), F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"))
