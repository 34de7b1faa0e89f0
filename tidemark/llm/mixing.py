"""Mixing sources to target weights by systematic sampling.

Sources share a budget by weight; a source's target stops at ``most`` times its size
and the excess is reshared until none is above. Within a source every document is
expected ``target / source size`` times. Documents are put in order of size, largest first, these
expectations are summed up, one offset per source is added, and a document is emitted
once for each integer boundary that its stretch of the sum crosses. In this
order the words taken differ from the target by one largest document at most.

Prefix sums are two-level: rows are range-partitioned by (source, size, id), so a
source with a third of all rows spreads over a third of the partitions; only counts
by (source, partition) are added up across partitions. Sources are numbered in the same
way and reshared by sums, so there may be as many as there are web hosts.

Null text has size 0. A null source is a source of its own, last in order. Ties and
repeated rows take consecutive places. The offset is a hash of seed and source, so
reruns agree. Texts of any length are handled whole. An empty table gives an empty
result. ``mix`` keeps extra columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, shuffle_width, stage

WORD = r"[^\x20\x09-\x0D]+"
LOW = (1 << 33) - 1


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """In [0, 1): the first 32 bits of an MD5 digest of seed and source."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), source), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Staged ``df`` with place: 1, 2, ... in that order. Only counts by partition are added up in one task."""
    rows = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND(F.lit(LOW))})
    before = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.join(before, "_part").select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Staged (source, place, weight, source_size, target), one row per row of ``sizes`` (source, source_size)."""
    cycle = F.array(*[F.lit(w) for w in weights])
    t = _numbered(sizes, F.col("source").asc_nulls_last())
    t = t.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    t = stage(t.withColumn("cap", F.col("source_size") * F.lit(float(most))))
    whole, every = t.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_ = float(whole or 0) * share, every or 0
    while True:  # sources that reach their cap leave the rest to the others
        full = F.col("cap") * F.lit(open_) <= F.lit(left) * F.col("weight")
        caps, still = t.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        now = float(whole or 0) * share - caps, still
        if now == (left, open_) or not still:
            break
        left, open_ = now
    level = F.lit(left / open_ if open_ else 0.0)
    return stage(t.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * level)).select("source", "place", "weight", "source_size", "target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Copies of each row: the columns of ``docs`` (id, source, size, and what else it has), source_size, target, copies.

    ``docs`` needs ``doc_id``, ``source`` and ``size``; keep it narrow. The names ``place``, ``_row``,
    ``_part``, ``_at``, ``source_size``, ``target`` and ``copies`` are the plan's own.
    """
    docs = stage(docs)
    names = docs.columns
    sources = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    order = [F.col("place"), F.col("size").desc(), F.col("doc_id")]
    placed = docs.join(sources.select("source", "place").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.drop("_source").repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND(F.lit(LOW))})
    before = placed.groupBy("place", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("place").orderBy("_part")) - F.col("_n")).drop("_n")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumns({"_rate": rate, "_offset": offset(F.col("source"), seed)}).drop("source", "weight")
    placed = placed.join(before, ["place", "_part"]).join(sources, "place")
    i = F.col("_before") + F.col("_at") - F.col("_first")
    copies = F.floor((i + 1) * F.col("_rate") + F.col("_offset")) - F.floor(i * F.col("_rate") + F.col("_offset"))
    return placed.select(*names, "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as the plan says.

    Rows are staged with a number, by which the narrow plan finds them again.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count("text").alias("size"))
    rows = stage(rows.withColumn("number", F.monotonically_increasing_id()))
    copies = plan(rows.select("doc_id", "source", "size", "number"), **settings).filter("copies > 0").select("number", "copies")
    taken = rows.select("number", "row").join(broadcast_if_small(copies), "number")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
