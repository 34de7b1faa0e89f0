"""Exact order statistics by key, without sorting or holding a key's values.

Equal values are counted first, combined in the tasks, and dealt by key and value. A
histogram of ``BUCKETS`` equal ranges between a key's least and greatest value tells which
bucket holds the wanted rank; the next pass counts within that bucket alone, between the least
and greatest value in it. Every other pass divides the logarithms, so values of very
different size take a dozen passes at most, not hundreds. Passes go on until each wanted rank
lies among ``FEW`` distinct values at most; those few are ranked by a window. What is
shuffled in a pass is the buckets' counts, combined in the tasks before; a hot key costs no
task more than its buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

BUCKETS, FEW = 1024, 10_000
#: Rows of targets (keys by ranks) that a broadcast may hold.
BROADCAST_TARGETS = 200_000


def _magnitude(v: Column) -> Column:
    """Grows with v as its sign and logarithm do: values of any size lie within 1500 of each other."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(F.nullif(v, F.lit(0.0)))) + 746.0))


def _bucket(v: Column, lo: Column, hi: Column, by_magnitude: bool) -> Column:
    """The range that holds ``v``: never falls as v grows, 0 at lo and the last at hi (lo < hi). Halves keep differences finite."""
    a, b, c = (_magnitude(x) if by_magnitude else x / 2 for x in (v, lo, hi))
    wide = F.least(F.floor((a - b) / F.nullif(c - b, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1))
    return F.when(c > b, wide).when(v > lo, BUCKETS - 1).otherwise(0).cast("int")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_TARGETS else df


_INF = float("inf")


def _prepared(values: DataFrame, keys: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """Staged distinct values (keys, _v, _m: how often); staged sums by key: how many values are below, within and beyond the finite ones, how many of these are distinct, their ends, mean, min and max."""
    given = values.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"))
    rows = staged(given.groupBy(*keys, "_v").agg(F.count("*").alias("_m")))
    finite = (F.abs("_v") < _INF) & ~F.isnan("_v")
    some = lambda c: F.sum(F.when(c, F.col("_m")).otherwise(0))
    sums = rows.groupBy(*keys).agg(
        some(F.col("_v") == -_INF).alias("_under"), some(finite).alias("_n"), some(F.col("_v") == _INF).alias("_over"), F.sum("_m").alias("n"), F.count_if(finite).alias("_d"),
        F.min(F.when(finite, F.col("_v"))).alias("_lo"), F.max(F.when(finite, F.col("_v"))).alias("_hi"),
        (F.sum(F.col("_v") * F.col("_m")) / F.nullif(F.sum("_m"), F.lit(0))).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"),
    )
    return rows, staged(sums.filter("n > 0"))


def _found(rows: DataFrame, asked: DataFrame, keys: list[str], few: int) -> DataFrame:
    """(keys, target, value) for ``asked``: the sums of each key with target and at."""
    same = [f"_key{i}" for i in range(len(keys))]
    renamed = lambda df: df.withColumnsRenamed(dict(zip(keys, same, strict=True)))
    at = F.col("at").cast("long") - F.col("_under")
    beyond = at - F.col("_n")
    rest = F.col("n") - F.col("_under") - F.col("_n")
    odd = F.when(at < 0, F.lit(-_INF)).when(beyond < F.col("_over"), F.lit(_INF)).when(beyond < rest, F.lit(float("nan")))
    told = F.when((at < 0) | (beyond >= 0), odd).when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    settled = (at < 0) | (beyond >= 0) | (F.col("_lo") == F.col("_hi"))
    done = [asked.filter(settled).select(*keys, "target", told.alias("value"))]
    now = asked.filter(~settled).select(*keys, "target", at.alias("_at"), "_d", "_lo", "_hi")
    by_magnitude = False
    while not (wide := now.filter(F.col("_d") > few)).isEmpty():
        t = _small(renamed(wide))
        inside = rows.join(t, [*(F.col(k).eqNullSafe(t[s]) for k, s in zip(keys, same, strict=True)), F.col("_v") >= t["_lo"], F.col("_v") <= t["_hi"]])
        counted = inside.groupBy(*keys, "target", "_at", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi"), by_magnitude).alias("_b"))
        counted = counted.agg(F.sum("_m").alias("_m"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_m").over(Window.partitionBy(*keys, "target").orderBy("_b"))  # BUCKETS rows at most
        held = counted.withColumn("_before", upto - F.col("_m")).filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_m")))
        held = staged(held.select(*keys, "target", (F.col("_at") - F.col("_before")).alias("_at"), "_d", "_lo", "_hi"))
        done.append(held.filter("_lo = _hi").select(*keys, "target", F.col("_lo").alias("value")))
        now = now.filter(F.col("_d") <= few).unionByName(held.filter("_lo < _hi"))
        by_magnitude = not by_magnitude
    t = _small(renamed(now))
    last = rows.join(t, [*(F.col(k).eqNullSafe(t[s]) for k, s in zip(keys, same, strict=True)), F.col("_v") >= t["_lo"], F.col("_v") <= t["_hi"]])
    upto = F.sum("_m").over(Window.partitionBy(*keys, "target").orderBy("_v"))  # ``few`` rows at most
    done.append(last.withColumn("_p", upto).filter((F.col("_p") > F.col("_at")) & (F.col("_p") - F.col("_m") <= F.col("_at"))).select(*keys, "target", F.col("_v").alias("value")))
    return reduce(DataFrame.unionByName, done)


def order_statistics(values: DataFrame, keys: list[str], column: str, places: Mapping[str, Column], few: int = FEW, also: Sequence[str] = ()) -> DataFrame:
    """(keys, n, ``also`` of mean, min and max, one column per place): the values at places, counted from 0, that are expressions of the count ``n``.

    Nulls don't count; NaN comes after all others; a null key is a key like any; a place
    beyond the end gives null.
    """
    rows, sums = _prepared(values, keys, column)
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("target"), at.cast("long").alias("at")) for name, at in places.items()]))
    found = _found(rows, sums.withColumn("_t", named).select(*sums.columns, "_t.target", "_t.at"), keys, few)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == name, F.col("value"))).alias(name) for name in places])
    other = wide.withColumnsRenamed({k: f"_w{i}" for i, k in enumerate(keys)})
    joined = sums.join(other, [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)] or F.lit(True))
    return joined.select(*keys, "n", *also, *places)


def medians(values: DataFrame, keys: list[str], column: str, few: int = FEW, also: Sequence[str] = ()) -> DataFrame:
    """(keys, n, ``also`` of mean, min and max, median): the middle value, or the mean of the two middle ones."""
    n = F.col("n")
    both = order_statistics(values, keys, column, {"_below": F.floor((n - 1) / 2), "_above": F.floor(n / 2)}, few, also)
    middle = F.when(F.col("_below") == F.col("_above"), F.col("_below")).otherwise(0.5 * F.col("_below") + 0.5 * F.col("_above"))
    return both.withColumn("median", middle).drop("_below", "_above")
