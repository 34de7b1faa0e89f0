"""Order statistics against sorting, over hard distributions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, selection

inf = math.inf
CASES = {
    "one value": [7.0] * 900, "two values": [1.0] * 500 + [2.0] * 500, "spread": list(np.random.default_rng(1).normal(size=3000)),
    "magnitudes": [10.0**k for k in range(-300, 300)] + [-(10.0**k) for k in range(-300, 300)], "extremes": [1.7e308, -1.7e308, 5e-324, 0.0, -0.0, 1.0] * 50,
    "hot value": [0.5] * 5000 + list(np.linspace(0, 1, 301)), "infinite": [-inf] * 40 + [inf] * 30 + [float(i) for i in range(100)], "nan": [math.nan] * 10 + [1.0, 2.0, 3.0],
    "single": [3.25], "nulls": [None, 4.0, None, 2.0],
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(None if k == "hot value" else k, v) for k, vs in CASES.items() for v in vs]
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(5)


@pytest.mark.parametrize("few", [0, 50, 10_000])
def test_places_equal_sorted_values(values, few):
    n = F.col("n")
    got = selection.order_statistics(values, ["k"], "v", {"least": F.lit(0), "low": F.floor(n / 10), "mid": F.floor(n / 2), "most": n - 1, "beyond": n}, few).collect()
    assert len(got) == len(CASES)
    for r in got:
        held = sorted((float(x) for x in CASES[r.k or "hot value"] if x is not None), key=lambda x: (math.isnan(x), x))
        want = [held[0], held[len(held) // 10], held[len(held) // 2], held[-1]]
        assert r.n == len(held) and r.beyond is None
        assert [str(x) if math.isnan(x) else x for x in (r.least, r.low, r.mid, r.most)] == [str(x) if math.isnan(x) else x for x in want], r.k


def test_medians_equal_the_built_in(spark):
    draw = np.random.default_rng(4)
    rows = spark.createDataFrame([(i % 7, float(x)) for i, x in enumerate(np.round(draw.exponential(size=4001), 2))], "k int, v double")
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    for few in (3, 10_000):
        assert {r.k: r.median for r in selection.medians(rows, ["k"], "v", few).collect()} == pytest.approx(want)
    assert selection.medians(rows, [], "v", 5).first().median == pytest.approx(rows.agg(F.median("v")).first()[0])


def test_no_task_holds_a_key(spark):
    """Plans have no window over a key's values and no percentile; a window ranks few rows only."""
    rows = spark.range(40_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 0.5).alias("v"))
    card = metrics.latency_summary(rows.withColumnRenamed("v", "value"), "k")
    text = card._jdf.queryExecution().toString().lower()
    assert "percentile" not in text and "median" not in text
    assert {(r.k, r.p50, r.p95, r.max, r.n) for r in card.collect()} == {(0, 10_000.0, 19_000.0, 19_999.0, 20_000), (1, 10_000.5, 19_000.5, 19_999.5, 20_000)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert selection.medians(none, ["k"], "v").count() == 0 and metrics.latency_summary(none, "k", "v").count() == 0
    assert metrics.field_statistics(none.withColumn("reward", F.col("v")), ["reward"]).count() == 0
