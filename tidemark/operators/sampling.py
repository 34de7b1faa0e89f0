"""One date per event, stratified into early, middle and late.

Events are shuffled by a digest of their key, so the draw is the same on any cluster; group
sizes are exact thirds of the shuffled order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUPS = ("early", "middle", "late")
#: Bounds of each group on the relative position, and the place to fall back to.
BOUNDS = {"early": (0.0, 1 / 3), "middle": (1 / 3, 2 / 3), "late": (2 / 3, 1.0 + 1e-9)}
CENTRES = {"early": 1 / 6, "middle": 0.5, "late": 5 / 6}
DRAW_BITS = 60


def draw(key: Column, seed: int) -> Column:
    """A pseudo-random integer of 60 bits: the head of the MD5 digest of seed and key. A null key is drawn like an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def relative_positions(rows: DataFrame) -> DataFrame:
    """Adds t (1..T), T and r = (t - 1) / (T - 1)."""
    event = Window.partitionBy("event_id")
    t = F.row_number().over(event.orderBy("forecast_date"))
    rows = rows.withColumns({"t": t, "T_Q": F.count("*").over(event)})
    return rows.withColumn("r", F.when(F.col("T_Q") > 1, (F.col("t") - 1) / (F.col("T_Q") - 1)).otherwise(0.0))


def _of_group(values: dict, part: int | None = None) -> Column:
    out = F.lit(None).cast("double")
    for g in GROUPS:
        v = values[g] if part is None else values[g][part]
        out = F.when(F.col("group") == g, F.lit(v)).otherwise(out)
    return out


def assign_groups(events: DataFrame, seed: int) -> DataFrame:
    """(event_id, group): k < n/3 early, k < 2n/3 middle, else late, k by shuffled order."""
    drawn = events.select("event_id", draw(F.col("event_id"), seed).alias("_d")).withColumn("_b", F.shiftright("_d", DRAW_BITS - 12))
    buckets = drawn.groupBy("_b").agg(F.count("*").alias("_n"))  # 4096 at most
    upto, whole = Window.orderBy("_b"), Window.partitionBy()
    buckets = buckets.select("_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    k = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_d", "event_id")) - 1
    placed = drawn.join(F.broadcast(buckets), "_b").select("event_id", k.alias("k"), "n")
    return placed.select("event_id", F.when(3 * F.col("k") < F.col("n"), "early").when(3 * F.col("k") < 2 * F.col("n"), "middle").otherwise("late").alias("group"))


def single_date(rows: DataFrame, seed: int = 20260918) -> DataFrame:
    """One row per event: a date drawn from the group's bin, or the one nearest its centre where the bin is empty."""
    placed = relative_positions(rows).join(assign_groups(rows.select("event_id").distinct(), seed), "event_id")
    inside = (F.col("r") >= _of_group(BOUNDS, 0)) & (F.col("r") < _of_group(BOUNDS, 1))
    far = F.round(F.abs(F.col("r") - _of_group(CENTRES)), 9)
    lot = draw(F.col("event_id") * 1009 + F.col("t"), seed + 1)
    placed = placed.withColumn("fallback", ~F.max(inside).over(Window.partitionBy("event_id"))).withColumn("inside", inside)
    order = Window.partitionBy("event_id").orderBy(F.col("inside").desc(), F.when(F.col("inside"), lot).otherwise(0), far, "t")
    return placed.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", "inside")


def statistics(chosen: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(stat, key, value): group counts, mean r by group and overall, histograms of r, t and T.

    With the ``rows`` that the sample was drawn from: their number and that of the sample,
    of events and fallbacks, and counts of belief_kind before and after.
    """
    row = lambda stat, key, value: [F.lit(stat).alias("stat"), key.cast("string").alias("key"), value.cast("double").alias("value")]
    count = lambda stat, key: chosen.groupBy(key.alias("k")).agg(F.count("*").alias("n")).select(*row(stat, F.col("k"), F.col("n")))
    r = F.round("r", 4)
    out = count("group_counts", F.col("group"))
    out = out.unionAll(chosen.groupBy("group").agg(F.round(F.avg(r), 4).alias("m")).select(*row("r_mean_by_group", F.col("group"), F.col("m"))))
    out = out.unionAll(chosen.agg(F.round(F.avg(r), 4).alias("m")).select(*row("r_mean", F.lit(""), F.col("m"))))
    out = out.unionAll(count("r_hist_10bins", F.least(F.floor(r * 10), F.lit(9))))
    out = out.unionAll(count("t_hist", F.col("t"))).unionAll(count("T_Q_hist", F.col("T_Q")))
    if rows is None:
        return out
    kinds = lambda stat, df: df.groupBy(F.col("belief_kind").alias("k")).agg(F.count("*").alias("n")).select(*row(stat, F.col("k"), F.col("n")))
    sizes = chosen.agg(F.count("*").alias("rows_out"), F.count_if("fallback").alias("fallbacks")).unpivot([], ["rows_out", "fallbacks"], "stat", "n")
    before = rows.agg(F.count("*").alias("rows_in"), F.count_distinct("event_id").alias("events")).unpivot([], ["rows_in", "events"], "stat", "n")
    sizes = sizes.unionAll(before).select("stat", F.lit("").alias("key"), F.col("n").cast("double").alias("value"))
    return out.unionAll(sizes).unionAll(kinds("kind_out", chosen)).unionAll(kinds("kind_in", rows))


def top_labels(chosen: DataFrame, k: int = 6) -> DataFrame:
    """The k most frequent labels; ties by first place in the input."""
    seen = chosen.groupBy(F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"), F.min("input_pos").alias("first"))
    return seen.orderBy(F.col("n").desc(), "first").limit(k).drop("first")
