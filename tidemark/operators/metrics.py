"""Aggregates over rollouts: fields, slices, pass@k, tools, latencies.

Every partial result carries its count, so partials merge exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import medians, order_statistics

#: Fields that are broken down by slice.
SLICE_FIELDS = ("brier", "log_prob", "accuracy", "p_truth", "info_alpha", "reward")
_STATS = ("mean", "min", "max", "median")


def _statistics(values: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """(keys, n, mean, min, max, median)."""
    return medians(values, keys, column, also=["mean", "min", "max"])


def field_statistics(samples: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, mean, min, max, median) of scalar fields over the samples that carry them; booleans are 0 or 1."""
    wide = samples.select(*[F.col(f).cast("double").alias(f) for f in fields])
    return _statistics(wide.unpivot([], fields, "field", "value"), ["field"]).select("field", "n", *_STATS)


def slice_label(value: Column) -> Column:
    """A safe label from a scalar (boolean: true or false)."""
    from ..functions.text import safe_key

    return safe_key(value.cast("string"))


def sliced_statistics(samples: DataFrame, labels: list[Column], fields: list[str], min_samples: int = 1, min_groups: int = 1) -> DataFrame:
    """Statistics by slice label and field, with n_samples and n_groups of the slice.

    A sample counts once for each distinct label. A field needs ``min_samples``; a slice
    needs ``min_groups`` distinct non-null groups where that is above 1.
    """
    wanted = [f for f in fields if f in SLICE_FIELDS]
    distinct = F.filter(F.array_distinct(F.array(*[slice_label(x) for x in labels])), lambda x: x.isNotNull())
    rows = samples.select("group_index", F.explode(distinct).alias("slice"), *[F.col(f).cast("double").alias(f) for f in wanted])
    groups = rows.groupBy("slice").agg(F.count_distinct("group_index").alias("n_groups"))
    stats = _statistics(rows.unpivot(["slice"], wanted, "field", "value"), ["slice", "field"]).filter(F.col("n") >= min_samples)
    if min_groups > 1:
        groups = groups.filter(F.col("n_groups") >= min_groups)
    kept = stats.join(groups, "slice")
    widest = kept.groupBy("slice").agg(F.max("n").alias("n_samples"))
    return kept.join(widest, "slice").select("slice", "field", "n", *_STATS, "n_samples", "n_groups")


def k_ladder(most: Column) -> Column:
    """Powers of two below ``most``, then ``most``."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    return F.array_append(F.filter(powers, lambda p: p < most), most.cast("long"))


def pass_rate(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n - c, k) / C(n, k), as a product."""
    miss = F.aggregate(F.sequence(F.lit(0).cast("long"), k - 1), F.lit(1.0), lambda a, i: a * ((n - c - i) / (n - i)))
    return F.when(n - c < k, 1.0).otherwise(1.0 - miss)


def pass_at_k(samples: DataFrame, ladder: list[int] | None = None) -> DataFrame:
    """(k, pass_at_k, n_groups) over groups of at least k; ``samples`` has group_index and correct (0 or 1)."""
    groups = samples.filter("group_index is not null").groupBy("group_index").agg(F.count("*").alias("n"), F.sum("correct").alias("c"))
    if ladder is None:
        rungs = groups.agg(F.max("n").alias("most")).select(F.explode(k_ladder(F.col("most"))).alias("k"))
    else:
        rungs = groups.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k).cast("long") for k in ladder])).alias("k"))
    sizes = groups.groupBy("n", "c").agg(F.count("*").alias("g"))  # few distinct sizes: rungs meet these, not groups
    cells = sizes.join(F.broadcast(rungs), F.col("n") >= F.col("k")).withColumn("p", pass_rate(F.col("n"), F.col("c"), F.col("k")))
    return cells.groupBy("k").agg((F.sum(F.col("p") * F.col("g")) / F.sum("g")).alias("pass_at_k"), F.sum("g").alias("n_groups"))


def summary(values: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """total, max, mean, min (4 digits) and the count that makes merging exact."""
    return values.groupBy(*keys).agg(
        F.sum(column).alias("total"), F.max(column).alias("max"), F.round(F.avg(column), 4).alias("mean"), F.min(column).alias("min"), F.count(column).alias("n")
    )


def merge_summaries(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of parts to summaries of the whole."""
    return parts.groupBy(*keys).agg(
        F.sum("total").alias("total"), F.max("max").alias("max"), F.round(F.sum("total") / F.sum("n"), 4).alias("mean"), F.min("min").alias("min"), F.sum("n").alias("n")
    )


def cache_hit_rate(read: Column, given: Column) -> Column:
    return F.when(given > 0, F.round(read / given, 4))


def tool_totals(calls: DataFrame, parse_errors: DataFrame | None = None) -> DataFrame:
    """Per tool: known, calls, successes, errors, latency_s, parse_errors. Tools with parse errors alone are unknown."""
    own = calls.groupBy("tool").agg(
        F.max("is_known").alias("is_known"), F.sum("calls").alias("calls"), F.sum("successes").alias("successes"),
        F.sum("errors").alias("errors"), F.round(F.sum("latency_s"), 4).alias("latency_s"),
    )
    if parse_errors is None:
        return own.withColumn("parse_errors", F.lit(0).cast("long"))
    both = own.join(parse_errors.groupBy("tool").agg(F.sum("n").alias("parse_errors")), "tool", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("calls", "successes", "errors", "latency_s", "parse_errors")}
    return both.withColumns(zero | {"is_known": F.coalesce("is_known", F.lit(False))})


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def tool_rates(totals: DataFrame, n_samples: int) -> DataFrame:
    """Per tool: avg_calls, success_rate, parse_error_rate."""
    return totals.select(
        "tool",
        _rate(F.col("calls"), F.lit(n_samples)).alias("avg_calls"),
        _rate(F.col("successes"), F.col("calls")).alias("success_rate"),
        _rate(F.col("parse_errors"), F.col("calls") + F.col("parse_errors")).alias("parse_error_rate"),
    )


def global_rates(totals: DataFrame) -> DataFrame:
    """Over executed calls: name_error_rate, success_rate, parse_error_rate, and quality (known calls, 1 without any)."""
    calls = F.sum("calls")
    unknown = F.sum(F.when(F.col("is_known"), 0).otherwise(F.col("calls")))
    return totals.agg(
        _rate(unknown, calls).alias("name_error_rate"), _rate(F.sum("successes"), calls).alias("success_rate"),
        _rate(F.sum("parse_errors"), calls).alias("parse_error_rate"), F.when(calls > 0, (calls - unknown) / calls).otherwise(1.0).alias("quality"),
    )


def latency_summary(values: DataFrame, key: str, column: str = "value") -> DataFrame:
    """mean, p50 = v[n div 2], p95 = v[min(n - 1, floor(.95 n))], max, n of the sorted values."""
    n = F.col("n")
    places = {"p50": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * 95 / 100))}
    return order_statistics(values, [key], column, places, also=["mean", "max"]).select(key, "mean", "p50", "p95", "max", "n")


def merge_counters(parts: DataFrame) -> DataFrame:
    return parts.groupBy("name").agg(F.sum("n").alias("n"))


def keep_last(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(F.col(order).desc()).limit(n)


def random_sample(rows: DataFrame, n: int, key: str | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows drawn by a hash of the integer ``key``, or of the whole row: the same ones for a seed on any cluster."""
    from .sampling import draw

    if key is None:
        return rows.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.lit(seed))).limit(n)
    return rows.orderBy(draw(F.col(key), seed), key).limit(n)
