"""Line numbers, ordered files, shards: splits, odd folders and what is read."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes
from tidemark.sources import positions, shards, sinks


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of a kilobyte, and each task gets several."""
    names = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _files(folder, sizes, line=lambda i: f"line {i} " + "x" * (i * 37 % 90)):
    folder.mkdir()
    n = 0
    for k, size in enumerate(sizes):
        with open(folder / f"part-{k:05d}.txt", "w") as file:
            for _ in range(size):
                file.write(line(n) + "\n")
                n += 1
    return [line(i) for i in range(n)]


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path, small_splits):
    lines = _files(tmp_path / "in", [300, 0, 1, 170, 40])
    got = positions.numbered_lines(spark, str(tmp_path / "in"))
    assert got.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, got.collect())) == list(enumerate(lines))


def test_blank_lines_count_only_if_asked(spark, tmp_path, small_splits):
    _files(tmp_path / "in", [200, 50], lambda i: " \t" if i % 3 == 0 else f"{i} " + "y" * 40)
    got = sorted(map(tuple, positions.numbered_lines(spark, str(tmp_path / "in")).collect()))
    assert [p for p, _ in got] == list(range(len(got))) and [int(v.split()[0]) for _, v in got] == [i for i in range(250) if i % 3]
    kept = positions.numbered_lines(spark, str(tmp_path / "in"), blank=True)
    assert kept.count() == 250 and kept.filter("value like '% yyy%' and position <> cast(substring_index(value, ' ', 1) as long)").isEmpty()


@pytest.mark.parametrize(("start", "end"), [(0, None), (10, 20), (299, 302), (301, 301), (470, 600), (600, None), (0, 1)])
def test_slices_equal_list_slices(spark, tmp_path, small_splits, start, end):
    lines = _files(tmp_path / "in", [300, 1, 170, 40])
    got = sorted(map(tuple, positions.slice_lines(spark, str(tmp_path / "in"), start, end).collect()))
    assert got == list(enumerate(lines))[start:end]


def test_slices_read_only_files_that_hold_them(spark, tmp_path):
    _files(tmp_path / "in", [100] * 8)
    files = positions.slice_lines(spark, str(tmp_path / "in"), 250, 390).inputFiles()
    assert {f.rpartition("/")[2] for f in files if "part-" in f and f.endswith(".txt")} == {"part-00002.txt", "part-00003.txt"}


def test_ordered_lines_come_back_in_order(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("k"))
    sinks.ordered_lines(rows, ["k", "id"], str(tmp_path / "out"), 9)
    assert len(list((tmp_path / "out").glob("part-*"))) > 4
    back = positions.numbered_lines(spark, str(tmp_path / "out")).orderBy("position").collect()
    want = [(r.k, r.id) for r in rows.orderBy("k", "id").collect()]
    assert [(json.loads(r.value)["k"], json.loads(r.value)["id"]) for r in back] == want


def test_episodes_keep_input_order_on_ties(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i % 3), "2024-01-01") for i in range(60)], "input_pos long, event_id string, forecast_date string").withColumn("tag", F.col("input_pos"))
    episodes.write_ordered(rows, "forecast_date", str(tmp_path / "out"), 4)
    back = [json.loads(r.value) for r in positions.numbered_lines(spark, str(tmp_path / "out")).orderBy("position").collect()]
    assert [(b["event_id"], b["tag"]) for b in back] == sorted(((str(i % 3), i) for i in range(60))) and "input_pos" not in back[0]


def _shards(spark, path, days=60):
    rows = spark.range(days * 4).select(F.col("id").alias("article_id"), F.date_format(F.date_add(F.lit("2024-01-10").cast("date"), (F.col("id") / 4).cast("int")), "yyyy-MM-dd").alias("published_date"))
    rows = rows.withColumn("shard", F.substring("published_date", 1, 7))
    rows.repartitionByRange(3, "shard", "article_id").sortWithinPartitions("shard", "article_id").write.partitionBy("shard").parquet(path)
    return rows


def _files_read(df) -> int:
    """Number of files that the scans of the executed plan read."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.executedPlan().collectLeaves() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.collectLeaves()
    stack = [leaves.apply(i) for i in range(leaves.size())]
    while stack:
        node = stack.pop()
        if "QueryStage" in node.getClass().getSimpleName():
            inner = node.plan().collectLeaves()
            stack += [inner.apply(i) for i in range(inner.size())]
        elif node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
    return total


def test_windows_prune_the_scan(spark, tmp_path):
    root = str(tmp_path / "articles")
    _shards(spark, root)
    (tmp_path / "articles" / "_tmp").mkdir()
    names = shards.shard_names(spark, root)
    assert [r.shard for r in names.collect()] == ["2024-01", "2024-02", "2024-03"]
    articles = shards.read_shards(spark, root)
    every = _files_read(articles.select("article_id"))
    one = shards.within(articles, "2024-02-03", "2024-02-20").select("article_id", "shard")
    assert {r.shard for r in one.distinct().collect()} == {"2024-02"} and 0 < _files_read(one) < every
    assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().toString().replace("\n", " ") or "(shard" in one._jdf.queryExecution().toString()
    windows = spark.createDataFrame([("2024-03-01", None), ("2024-02-27", "2024-03-02")], "start string, cutoff string")
    some = shards.for_windows(articles, names, windows)
    assert {r.shard for r in some.collect()} == {"2024-02", "2024-03"}
    assert "dynamicpruning" in some._jdf.queryExecution().toString().lower() and _files_read(some.select("article_id")) < every


def test_daily_names_and_optional_columns(spark, tmp_path):
    root = str(tmp_path / "articles")
    rows = spark.createDataFrame([(1, "2024-01-05", "a"), (2, "2024-01-06", "b")], "article_id long, shard string, title string")
    rows.write.partitionBy("shard").parquet(root)
    read = shards.read_shards(spark, root)
    assert dict(read.dtypes)["shard"] == "string" and read.filter("summary is null and text_truncated is null").count() == 2
    assert [r.article_id for r in shards.within(read, "2024-01-06", None).collect()] == [2]


def test_ordinals_and_rejected_shards(spark, tmp_path):
    rows = _shards(spark, str(tmp_path / "left"))
    left = shards.ordinals(shards.read_shards(spark, str(tmp_path / "left")).select("shard", "article_id"))
    want = {}
    for r in rows.orderBy("article_id").collect():
        want.setdefault(r.shard, []).append(r.article_id)
    got = {(r.shard, r.row): r.article_id for r in left.collect()}
    assert got == {(s, i): a for s, ids in want.items() for i, a in enumerate(ids)}
    short = left.filter("not (shard = '2024-01' and row = 3) and shard <> '2024-03'").withColumnRenamed("article_id", "other")
    assert sorted(map(tuple, shards.misaligned(left, short).collect())) == [("2024-01", len(want["2024-01"]), len(want["2024-01"]) - 1), ("2024-03", len(want["2024-03"]), 0)]
    both = shards.zipped(left, short)
    assert both.filter("article_id <> other").isEmpty() and [r.shard for r in both.select("shard").distinct().collect()] == ["2024-02"]


def test_ranges_follow_offsets(spark):
    metadata = spark.createDataFrame([("2024-01", {"2024-01-01": [0, 3], "2024-01-02": [3, 5], "2024-01-09": [5, 9]}), ("2024-02", {}), ("2024-03", None)], "shard string, day_offsets map<string, array<int>>")
    sizes = spark.createDataFrame([("2024-01", 9), ("2024-02", 4), ("2024-03", 6), ("2024-04", 2)], "shard string, n long")
    windows = [(1, "2024-01-02", "2024-01-05"), (2, "2024-01-03", "2024-01-04"), (3, None, None), (4, None, "2024-02-01"), (5, "2024-04-01", None), (6, "2024-01-02T09:00:00", "2024-01-09")]
    got = shards.day_ranges(metadata, sizes, spark.createDataFrame(windows, "query_id long, start string, cutoff string")).collect()
    want = {(1, "2024-01", 3, 5), (4, "2024-01", 0, 9), (4, "2024-02", 0, 4), (5, "2024-04", 0, 2), (6, "2024-01", 3, 9)}
    assert {tuple(r) for r in got} == want | {(3, s, 0, n) for s, n in (("2024-01", 9), ("2024-02", 4), ("2024-03", 6), ("2024-04", 2))}
