"""Streams that stop and go on: nothing is lost, nothing comes twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import state

STEP = "event_id long, step_idx long, notebook string"


def _arrive(spark, rows, kind, folder):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)


def test_notebooks_wait_for_earlier_steps_across_restarts(spark, tmp_path):
    def run():
        steps = spark.readStream.schema(STEP).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        state.carried_notebook(steps, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return {tuple(r) for r in spark.read.schema(f"{STEP}, prev_notebook string").parquet(f"{tmp_path}/out").collect()}

    _arrive(spark, [(1, 2, "c"), (1, 0, "a"), (2, 1, "y"), (3, 0, None)], STEP, f"{tmp_path}/in")
    first = run()
    assert first == {(1, 0, "a", None), (3, 0, None, None)}
    assert run() == first  # nothing new: nothing written
    _arrive(spark, [(1, 1, "b"), (1, 0, "again"), (3, 1, "z")], STEP, f"{tmp_path}/in")
    _arrive(spark, [(2, 0, None), (3, 1, "again"), (1, 2, "again")], STEP, f"{tmp_path}/in")
    want = first | {(1, 1, "b", "a"), (1, 2, "c", "b"), (3, 1, "z", None), (2, 0, None, None), (2, 1, "y", None)}
    assert run() == want
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(want)


def test_log_has_each_unit_once(spark, tmp_path):
    kind = "event_id string, rollout_idx int"
    done = spark.createDataFrame([("a", 0), ("b", None)], kind)
    worked = lambda rows: rows.withColumn("brier", F.lit(0.25))

    def run():
        units = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        state.evaluation_log(units, done, worked, f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r.event_id, r.rollout_idx) for r in spark.read.schema(f"{kind}, brier double").json(f"{tmp_path}/log").filter("brier = 0.25").collect())

    _arrive(spark, [("a", 0), ("a", 1), ("a", 1), ("b", 0)], kind, f"{tmp_path}/in")
    assert run() == [("a", 1)]
    _arrive(spark, [("a", 1), ("b", 1), ("c", None)], kind, f"{tmp_path}/in")
    _arrive(spark, [("c", 0), ("b", 1), ("d", 3)], kind, f"{tmp_path}/in")
    assert run() == [("a", 1), ("b", 1), ("c", 0), ("d", 3)]
    assert run() == [("a", 1), ("b", 1), ("c", 0), ("d", 3)]


def test_the_session_keeps_its_setting(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with state.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_bins_tell_their_best_day_once(spark, tmp_path):
    kind = "event_id long, day string, t long, n long, k long, bin long, weight double"
    weights = [0.1, 0.9, 0.9, 0.2, 0.5, 0.5, 0.3]  # 7 days in 3 bins: [0, 2), [2, 4), [4, 7)
    rows = [(1, f"d{t}", t, 7, 3, ((t + 1) * 3 - 1) // 7, w) for t, w in enumerate(weights)] + [(2, f"d{t}", t, 2, 3, t, 0.0) for t in range(2)]

    def run():
        days = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        state.dates_by_bin(days, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        return sorted((r.event_id, r.bin, r.day) for r in spark.read.schema("event_id long, bin long, day string, weight double").parquet(f"{tmp_path}/out").collect())

    _arrive(spark, [rows[6], rows[1], rows[0], rows[0], rows[7]], kind, f"{tmp_path}/in")
    assert run() == [(1, 0, "d1"), (2, 0, "d0")]
    _arrive(spark, [rows[4], rows[0], rows[3], rows[6]], kind, f"{tmp_path}/in")
    _arrive(spark, [rows[5], rows[2], rows[8]], kind, f"{tmp_path}/in")
    assert run() == [(1, 0, "d1"), (1, 1, "d2"), (1, 2, "d5"), (2, 0, "d0"), (2, 1, "d1")]
