"""Hand-computed cases and properties of the operators."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import answers, scores, text
from tidemark.operators import advantage, curation, dates, episodes, evaluation, metrics, rendering, retrieval, sampling, taxonomy, traces, volume
from tidemark.sources import config, files, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def dist(**p):
    return F.create_map(*[F.lit(v) for kv in p.items() for v in kv]).cast("map<string,double>")


def test_scores(spark):
    assert one(spark, scores.brier(dist(YES=0.63, NO=0.37), F.lit("YES"))) == pytest.approx(0.2738)
    assert one(spark, scores.brier(dist(A=0.5, B=0.5), F.lit("C"))) == pytest.approx(1.5)
    assert one(spark, scores.floored_log(F.lit(0.63))) == pytest.approx(-0.462035, abs=1e-6)
    assert one(spark, scores.floored_log(F.lit(0.0))) == pytest.approx(math.log(1e-3))
    assert one(spark, scores.floored_log(F.lit(None).cast("double"))) is None
    assert one(spark, scores.accuracy(dist(A=0.4, B=0.4, C=0.2), F.lit("A"))) == 0.5
    assert one(spark, scores.info_alpha(F.lit(math.log(0.63)), F.lit(0.5))) == pytest.approx(0.231112, abs=1e-6)
    assert one(spark, scores.normalize(dist(YES=0.54, NO=0.36))) == pytest.approx({"YES": 0.6, "NO": 0.4})
    assert one(spark, scores.normalize(dist(A=-1.0, B=0.0))) == {}
    assert one(spark, scores.inner_product(scores.unit(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1.0), F.lit(0.0)))) == pytest.approx(0.6)


def test_step_score(spark):
    none = F.lit(None).cast("map<string,double>")
    crowd = F.lit(None).cast("double")
    full = scores.answer_quality(F.lit(True), F.lit(True), F.lit(0.9))
    assert one(spark, scores.score(dist(YES=0.54, NO=0.36), F.lit("YES"), crowd, full, "brier")).reward == pytest.approx(-0.32 - 1 / 3)
    missing = one(spark, scores.score(dist(YES=1.0), F.lit(" ? "), crowd, full, "brier"))
    assert (missing.reward, missing.brier, missing.error) == (0.0, None, "missing_truth")
    absent = one(spark, scores.score(none, F.lit("YES"), crowd, F.lit(0.0), "log_prob"))
    assert absent.reward == pytest.approx(-7.907755, abs=1e-6) and absent.parse_ok is False
    empty = one(spark, scores.score(dist(A=-1.0), F.lit("A"), crowd, full, "brier"))
    assert (empty.brier, empty.parse_ok) == (2.0, True)


def test_same_distribution(spark):
    assert one(spark, scores.same_distribution(dist(A=0.5, B=0.5), dist(B=0.52, A=0.48)))
    assert not one(spark, scores.same_distribution(dist(A=0.5, B=0.5), dist(A=0.5)))
    assert not one(spark, scores.same_distribution(F.lit(None).cast("map<string,double>"), dist(A=0.5)))


@pytest.mark.parametrize(
    ("blob", "value", "strict"),
    [
        ('{"a": 0.5}', {"a": 0.5}, True), ('{"a": 0.5} junk', None, False), ("{a: 0.5, b c: 1}", {"a": 0.5, "b c": 1}, False),
        ("{'a': 0.5}", {"a": 0.5}, False), ("[1]", None, False), ("", None, False), (None, None, False), ('{"a": 1, "a": 2}', {"a": 2}, True),
    ],
)
def test_lenient_objects(blob, value, strict):
    assert answers.parse_object(blob) == (value, strict)


def test_answer_columns(spark):
    rows = spark.createDataFrame([("x<answer>a<answer>{\"YES\": 1, \"b\": true}</answer>",), ("none",), (None,)], "t string")
    got = [r.a for r in rows.select(answers.answer("t").alias("a")).collect()]
    assert (got[0].forecast, got[0].tag_present, got[0].strict_json, got[0].all_numeric) == ({"YES": 1.0}, True, True, False)
    assert [g.tag_present for g in got[1:]] == [False, False]
    note = spark.createDataFrame([('<belief_notebook>{"assessment": {"p": {"A": 0.5}}}</belief_notebook>',)], "t string")
    n = note.select(answers.notebook("t").alias("n")).first().n
    assert (n.parseable, n.has_assessment_p, n.p) == (True, True, {"A": 0.5})


def test_text(spark):
    raw = ' id=<urn:uuid:ABCDEF01-2345-6789-ABCD-EF0123456789>, '
    assert one(spark, text.canonical_id(F.lit(raw))) == "abcdef01-2345-6789-abcd-ef0123456789"
    assert one(spark, text.display_id(F.lit("abcdef01-2345-6789-abcd-ef0123456789"))).startswith("<urn:uuid:")
    assert one(spark, text.last_tag(F.lit("<answer>a<answer>b</answer>"), "answer")) == "b"
    assert one(spark, text.strip_think(F.lit("a</think>b</think>\n c"))) == "c"
    assert one(spark, text.safe_key(F.lit("//a b//"))) == "a_b"
    assert str(one(spark, text.lenient_date(F.lit("2025/1/5 x")))) == "2025-01-05"
    assert one(spark, text.lenient_date(F.lit("2025-13-40"))) is None
    assert one(spark, text.snippet(F.lit(" a  b "), F.lit("c"))) == "a b"
    long = "x" * 200 + ". " + "y" * 200
    assert one(spark, text.snippet(F.lit(""), F.lit(long))) == "x" * 200 + "."
    assert one(spark, text.truncate_tokens(F.lit("a b c"), 2)) == "a b..."
    assert one(spark, text.termination(F.lit(None).cast("array<string>"))) == "task_complete"


def test_curation(spark):
    for label, expected in [("Player A", True), ("Song E by Artist E", True), ("placeholder x", True), ("Other", True), ("Will Player B win", True), ("Anna", False), (None, False)]:
        assert one(spark, curation.placeholder_name(F.lit(label).cast("string"))) is expected
    legs = [("Player A", "", "1", None), ("Ann", "", "2", None), ("Bob", "", "3", None)]
    volume_ = {"1": [(0.0,)], "2": [(5.0,)]}
    schema = "belief_kind string, resolved_label string, markets array<struct<label:string,question:string,market_id:string,closed_time:string>>, num_markets int, daily_volume_by_market map<string,array<struct<notional:double>>>"
    rows = [("multi_neg_risk", "Ann", legs, 3, volume_), ("multi_neg_risk", "Player A", legs, 3, volume_), ("multi_neg_risk", "Ann", legs, 3, {"1": [(5.0,)]}), ("binary", "Player A", legs, 3, volume_), ("multi_neg_risk", "Ann", legs[1:2], 1, volume_)]
    got = curation.filter_questions(spark.createDataFrame(rows, schema)).collect()
    assert [(r.belief_kind, len(r.markets), r.num_markets) for r in got] == [("multi_neg_risk", 2, 2), ("multi_neg_risk", 3, 3), ("binary", 3, 3)]


def test_taxonomy(spark):
    pairs = spark.createDataFrame([("crypto", "crypto"), ("sports", "sports"), ("politics", "politics"), ("world", "geopolitics"), ("up-or-down", "finance")], "tag string, domain string")
    tags = {1: ["crypto", "sports"], 2: ["politics", "world"], 3: ["sports", "sports", "crypto"], 4: ["up-or-down"], 5: ["march-3"]}
    rows = spark.createDataFrame([(k, t) for k, ts in tags.items() for t in ts], "event_id int, tag string")
    got = {r.event_id: (r.domain, r.domains) for r in taxonomy.classify(rows, pairs).collect()}
    assert got[1] == ("crypto", ["crypto", "sports"]) and got[2][0] == "geopolitics" and got[3][0] == "sports"
    assert got[4] == ("unknown", []) and got[5] == ("unknown", [])
    assert taxonomy.ambiguous_tags(pairs.union(spark.createDataFrame([("world", "tech")], "tag string, domain string"))).count() == 1


def _days(spark, p, close):
    rows = [(1, i, f"2025-01-{i + 1:02d}", float(x)) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "event_id int, pos int, day string, p double")
    return dates.belief_delta_binary(df).withColumns({"news": F.lit(None).cast("double"), "resolution": F.lit(close).cast("date")})


@pytest.mark.parametrize(
    ("p", "close", "expected"),
    [
        ([0.1, 0.1, 0.2, 0.2, 0.5, 0.45, 0.45, 0.6, 0.6, 0.9], "2025-01-12", ["03", "05", "10"]),
        ([0.1, 0.1, 0.2, 0.2, 0.5, 0.45, 0.45, 0.6, 0.6, 0.9], "2025-01-11", ["03", "05", "08"]),
        ([0.3] * 10, "2025-01-12", ["03", "06", "10"]),
    ],
)
def test_dates(spark, p, close, expected):
    got = dates.select_dates(_days(spark, p, close), k=3).orderBy("pos").collect()
    assert [r.day[-2:] for r in got] == expected


def test_date_parts(spark):
    assert one(spark, dates.auto_k(F.lit(25), 1, 10, 0.5)) == 2 and one(spark, dates.auto_k(F.lit(9), 3, 10, 0.5)) == 3
    assert [one(spark, dates.bin_of(F.lit(t), F.lit(10), F.lit(3))) for t in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    near = _days(spark, [0.1, 0.2], "2025-01-02")
    assert dates.trim_for_leakage(near, 5).count() == 2
    legs = spark.createDataFrame([(1, "A", 0, 0.5), (1, "B", 0, 0.5), (1, "A", 1, 0.7), (1, "B", 1, 0.3), (1, "A", 2, None), (1, "B", 2, 0.1)], "event_id int, leg string, pos int, p double")
    assert [round(r.delta, 6) for r in dates.belief_delta_multi(legs).orderBy("pos").collect()] == [0, 0.2, 0]
    closed = F.array(F.lit("2025-02-01T00"), F.lit("bad"))
    nothing = F.lit(None).cast("string")
    assert str(one(spark, dates.resolution_date(F.lit("2025-1-5"), closed, nothing, nothing))) == "2025-02-01"


def test_crowd(spark):
    rows = spark.createDataFrame([(1, "no", 0.3), (2, "x", 0.3), (3, "YES", 0.3)], "event_id int, resolved_label string, p double")
    got = {r.event_id: r.crowd for r in dates.crowd_on_truth(rows).collect()}
    assert got[1] == pytest.approx(0.7) and got[2] is None and got[3] == 0.3


def test_shards_and_windows(spark):
    rows = spark.createDataFrame([("2024-12",), ("2025-01",), ("2025-03",), ("2025-04",)], "shard string")
    assert [r.shard for r in rows.filter(retrieval.prune_shards("shard", "2025-01-15", "2025-03-10")).orderBy("shard").collect()] == ["2025-01", "2025-03"]
    late = F.lit("2025-01-05T10:00")
    assert one(spark, retrieval.servable(late, F.lit(None).cast("string"), F.lit("2025-01-05"))) is False
    assert one(spark, retrieval.in_window(late, F.lit(None).cast("string"), F.lit("2025-01-05"))) is True
    assert volume.earliest_shard(rows).first().start == "2024-12-01"


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, "2025-01-01", "2025-04-01")], "query_id int, article_id int, score double, published_date string, cutoff string")
    assert retrieval.rerank(hits, 1, 0.7, 180.0).first().score == pytest.approx(0.5)


def test_render(spark, small):
    from tidemark.plans.queries import search_render

    line = search_render(spark, small).first().results
    assert line.startswith("[1] ") and "\nscore: " in line


def test_numbers_are_rounded_as_stored(spark):
    numbers = [0.35445, 0.38615, 0.41405, 0.03125, 0.09375, -0.35445, -0.00001, 0.0, 12345.67895, 1.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    assert [r.s for r in rows.select("i", text.fixed("x", 4).alias("s")).orderBy("i").collect()] == [f"{x:.4f}" for x in numbers]


def test_render_of_halves_and_ties_matches_sql(spark, tmp_path):
    """Scores that print as their stored value rounds, and scores that are equal in the digits that rank them."""
    from compare import TABLES, differences

    from tidemark.plans.queries import SQL, search_render

    first = {0: 1.0, 4: 0.5000001, 5: 0.5000004, 6: 0.35445, 7: 0.38615, 8: 0.41405}
    spark.createDataFrame([(i, [x, 0.0], 0) for i, x in first.items()], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, f"text {i}", "s") for i in first], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in set(TABLES) - {"embeddings", "documents"}:
        spark.range(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert not differences(search_render(spark, str(tmp_path)), SQL["search_render"], str(tmp_path))


def test_turns_and_advantage(spark):
    rows = [(1, 0, "user", False), (1, 1, "assistant", False), (1, 2, "user", True), (1, 3, "assistant", False), (1, 4, "user", False)]
    got = traces.turns(spark.createDataFrame(rows, "conv_id int, pos int, role string, tool_result boolean"))
    assert [r.turn for r in got.orderBy("pos").collect()] == [0, 1, 1, 2, 0]
    samples = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 5.0), (None, 1.0), (None, 3.0)], "group_index int, reward double")
    by = {(r.group_index, r.reward): r.advantage for r in advantage.group_advantage(samples, True).collect()}
    assert by[1, 1.0] == pytest.approx(-0.999999) and by[2, 5.0] == 0.0 and by[None, 3.0] == pytest.approx(0.7071, abs=1e-4)


def test_metrics(spark):
    groups = spark.createDataFrame([(1, c) for c in (1, 0, 0, 0)] + [(2, 1), (2, 1)], "group_index int, correct int")
    assert {r.k: round(r.pass_at_k, 6) for r in metrics.pass_at_k(groups).collect()} == {1: 0.625, 2: 0.75, 4: 1.0}
    for most, ladder in [(12, [1, 2, 4, 8, 12]), (16, [1, 2, 4, 8, 16]), (1, [1])]:
        assert one(spark, metrics.k_ladder(F.lit(most))) == ladder
    v = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)], "name string, value double")
    r = metrics.latency_summary(v, "name").first()
    assert (r["mean"], r.p50, r.p95, r["max"], r.n) == (2.5, 3, 4, 4, 4)
    parts = spark.createDataFrame([("a", 10.0, 6.0, 4.0, 2), ("a", 9.0, 5.0, 1.0, 3)], "k string, total double, max double, min double, n int")
    m = metrics.merge_summaries(parts, ["k"]).first()
    assert (m["total"], m["mean"], m["max"], m["min"]) == (19, 3.8, 6, 1)
    totals = spark.createDataFrame([("search", True, 8, 6, 0), ("foo", False, 2, 0, 2)], "tool string, is_known boolean, calls int, successes int, parse_errors int")
    g = metrics.global_rates(totals).first()
    assert (g.name_error_rate, g.success_rate, g.parse_error_rate, g.quality) == pytest.approx((0.2, 0.6, 0.2, 0.8))
    assert {r.tool: r.parse_error_rate for r in metrics.tool_rates(totals, 2).collect()}["foo"] == 0.5


def test_scorecard(spark):
    rows = [(False, True, 0.2738, -0.462035, 1.0, 0.231112), (False, True, 1.5, -6.907755, 0.0, None), (False, False, 2.0, -6.9, 0.0, None), (True, None, None, None, None, None), (False, None, None, None, None, None)]
    card = evaluation.scorecard(spark.createDataFrame(rows, "has_error boolean, parse_ok boolean, brier double, log_prob double, accuracy double, info_alpha double"))
    r = card.first()
    assert (r.n_rows, r.n_scored, r.n_errors, r.n_info_alpha) == (5, 2, 1, 1)
    assert (r.brier, r.log_loss, r.accuracy) == pytest.approx((0.8869, 3.684895, 0.5))
    assert "  brier        0.8869" in evaluation.card_text(card).first().card


def test_sampling_groups(spark):
    rows = spark.createDataFrame([(e, f"2025-01-{d:02d}") for e in range(9) for d in range(1, e + 2)], "event_id int, forecast_date string")
    got = sampling.single_date(rows).collect()
    assert len(got) == 9 and sorted(r.group for r in got) == ["early"] * 3 + ["late"] * 3 + ["middle"] * 3
    assert [tuple(r) for r in sampling.single_date(rows).orderBy("event_id").collect()] == sorted(map(tuple, got))


def test_rendering(spark):
    q = "struct<title:string,body:string,close_date:string,belief_kind:string,markets:array<struct<label:string,question:string>>>"
    rows = spark.createDataFrame([(("T", " b ", "2025-01-02T1", "multi_neg_risk", [("A", "qa"), ("B", "")]),)], f"q {q}")
    got = rows.select(rendering.step_prompt(rendering.question_text(F.col("q")), F.lit("2025-01-01"), F.lit(None).cast("string")).alias("x")).first().x
    assert got.startswith("Question: T\nResolves: 2025-01-02\nOutcomes (2, exactly one resolves YES):\n  - 'A': qa\n  - 'B': (no per-leg question)\n")
    assert got.endswith("context:\nb\n\nForecast date: 2025-01-01\n\nBelief Notebook: None")


def test_sources_and_sinks(spark, tmp_path):
    lines = tmp_path / "r.jsonl"
    lines.write_text('{"event_id": "a", "parse_ok": true, "brier": 0.5}\nbroken\n\n{"event_id": "b", "error": null}\n')
    assert {r.event_id: r.has_error for r in files.results(spark, str(lines)).collect()} == {"a": False, "b": True}
    assert files.completed(spark, str(tmp_path / "none")).count() == 0
    assert files.lenient_json(spark, str(lines), "event_id string").filter("event_id is not null").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.strict_json(spark, str(lines), "event_id string").collect()
    with pytest.raises(ValueError, match="blank"):
        files.unbroken_json(spark, str(lines), "event_id string")
    (tmp_path / "v.json").write_text(json.dumps({"2025-01-01T0": 1, "2025-01-01": 5, "2025-01-02": 2}))
    assert {r.day: r.n for r in files.volume_json(spark, str(tmp_path / "v.json")).collect()} == {"2025-01-01": 5, "2025-01-02": 2}
    (tmp_path / "h.json").write_text('{"z": [1, null], "a": [0.5]}')
    h = spark.read.text(str(tmp_path / "h.json")).select(files.history("value").alias("h")).first().h
    assert [(x.leg_idx, x.label, x.series) for x in h] == [(0, "z", [1.0, None]), (1, "a", [0.5])]
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "event_id int, x string")
    sinks.episodes(rows.orderBy("event_id"), str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ['{"event_id":1,"x":"a"}', '{"event_id":2,"x":"b"}']
    sinks.append_records(rows, str(tmp_path / "log"))
    sinks.append_records(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.manifest(spark, {"a": 1}, {"p": "x"}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value)["config"] == {"a": 1}
    assert config.RunConfig.from_dict({"rollouts": 2}, rollouts=3).rollouts == 3
    with pytest.raises(ValueError, match="unknown"):
        config.RunConfig.from_dict({"nope": 1})


@pytest.fixture
def small_splits(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@pytest.mark.parametrize("style", [{}, {"separators": (",", ":")}, {"indent": 2}])
@pytest.mark.parametrize("tail", ["", ", x", ',"\\\\', ",, ,", ' \\" {é}'])
def test_volume_object_in_splits(spark, tmp_path, small_splits, style, tail, monkeypatch):
    """An object that lies in several splits; keys with commas, quotes, braces and backslashes."""
    monkeypatch.setattr(files, "_STRETCH", 100)
    raw = {f"2025-01-{i % 7 + 1:02d} {i}{tail}": i * 37 % 1001 for i in range(600)}
    (tmp_path / "v.json").write_text(json.dumps(raw, **style))
    assert {r.day: r.n for r in files.volume_json(spark, str(tmp_path / "v.json")).collect()} == {k[:10]: n for k, n in raw.items()}


def test_volume_objects(spark, tmp_path):
    for name, text_ in (("a", ' {"2025-01-01": 1, "2025-01-02": 7, "2025-01-01": 2}\n'), ("b", "{ }"), ("c", '{"2025-01-02T1,5": 3}\n'), ("d", '{"2025-01-03": 9}')):
        (tmp_path / name).write_text(text_)
    assert {r.day: r.n for r in files.volume_json(spark, str(tmp_path)).collect()} == {"2025-01-01": 2, "2025-01-02": 3, "2025-01-03": 9}


@pytest.mark.parametrize(
    "broken", ['{"2025-01-01": 1,}', '{"2025-01-01": 1,, "2025-01-02": 2}', '{"2025-01-01": 1, "2025-01-02": 2', '"2025-01-01": 1, "2025-01-02": 2}', '{"2025-01-01": 1} {}', '{"2025-01-01": 1, 2}', '{"2025-01-01": "x"}', '{"2025-01-01, 1}']
)
def test_volume_that_is_no_object(spark, tmp_path, broken):
    (tmp_path / "v.json").write_text(broken)
    with pytest.raises(Exception, match="(?i)malformed"):
        files.volume_json(spark, str(tmp_path / "v.json")).collect()


def test_volume_of_many_keys(spark, tmp_path, monkeypatch):
    """A hundred thousand keys took more than a minute while each key was looked up in the whole object."""
    import time

    from compare import TABLES, differences

    from tidemark.plans import records
    from tidemark.plans.registry import SQL

    monkeypatch.setattr(records, "_KEYS", 70_000)
    ts = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 7_000_000)
    spark.range(200_000).select(F.col("id").alias("event_id"), ts.alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    for name in set(TABLES) - {"events"}:
        spark.range(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    start = time.time()
    assert not differences(records.volume_scan(spark, str(tmp_path)), SQL["volume_scan"], str(tmp_path))
    assert time.time() - start < 60


def test_articles_with_optional_columns(spark, tmp_path):
    spark.createDataFrame([("t", "x", "1", "u")], "title string, text string, article_id string, url string").write.parquet(str(tmp_path / "a" / "shard=2025-01"))
    rows = files.articles(spark, str(tmp_path / "a"))
    assert rows.first().summary is None
    (tmp_path / "m" / "shard=2025-01").mkdir(parents=True)
    (tmp_path / "m" / "shard=2025-01" / "metadata.json").write_text('{"day_offsets": {"2025-01-01": [0, 1]}, "scrape_truncation": {"tokenizer": "t", "token_budget": 8000}}')
    meta = files.shard_metadata(spark, str(tmp_path / "m" / "*" / "metadata.json"))
    assert (meta.first().shard, meta.first().day_offsets) == ("2025-01", {"2025-01-01": [0, 1]})
    assert retrieval.render_articles(rows).first().article == "id: 1\ntitle: t\nurl: u\npublished: (no date)\n\nx"
    assert files.served_text(rows, meta, "t", 8000).first().cached is None


def test_episodes(spark):
    day = spark.createDataFrame([(1, "2025-01-02", 0.2), (1, "2025-01-01", None), (10, "2025-01-01", 0.5), (2, "2025-01-01", 0.5)], "event_id int, day string, crowd double")
    rows = episodes.memory_on(day).withColumn("input_pos", F.col("event_id"))
    assert [r.event_id for r in episodes.ordered(rows, "entry").collect()] == [10, 2, 1]
    free = episodes.memory_free(rows)
    assert [(r.forecast_date, r.crowd_prob) for r in free.filter("event_id = 1").orderBy("forecast_date").collect()] == [("2025-01-01", None), ("2025-01-02", 0.2)]
    assert episodes.decode(free, 2, 10).count() == 1
    with pytest.raises(ValueError, match="memory-free"):
        episodes.check_mode(free, "memory-on")
    assert one(spark, episodes.truth(F.lit(" yes "), F.lit("binary"))) == "YES"


def test_streams(spark, tmp_path):
    from tidemark.streaming import runs

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "name string, n long").write.json(source)
    stream = runs.record_stream(spark, source, "name string, n long")
    runs.drain_counters(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.name: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 3, "b": 1}


def test_small_projections(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, 0.5, "task_complete", 0, "2025-01-01"), (2, 8, 0.1, "timeout", 1, "2025-01-02")], "group_index int, rollout_id int, reward double, termination string, step_idx int, forecast_date string")
    assert [r.status for r in evaluation.sample_rows(rows).orderBy("group_index").collect()] == ["COMPLETED", "TRUNCATED"]
    full = evaluation.records(rows)
    assert full.columns == list(evaluation.RECORD) and len(full.columns) == 34 and full.first().brier is None
    assert one(spark, episodes.merged_spec(F.lit("d"), F.lit("d"), F.lit("b"))) == "b"
    assert one(spark, episodes.merged_spec(F.lit("d"), F.lit("o"), F.lit("b"))) == "o"
    q = F.struct(F.lit("t").alias("title"))
    assert one(spark, episodes.question_group(q)) == one(spark, episodes.question_group(q)) < 1 << 40
    assert one(spark, episodes.step_group(F.lit(3), F.lit(2), 10)) == 32
    assert [r.group_index for r in metrics.keep_last(rows, 1, "group_index").collect()] == [2]
    assert metrics.random_sample(rows, 1).count() == 1
    sinks.metric_table(rows.select("reward"), str(tmp_path / "m"), 3)
    assert spark.read.parquet(str(tmp_path / "m")).first().step == 3
    blocks = spark.createDataFrame([([("a", None, None), (None, ("i", "f", "{}"), None), ("b", None, None)],)], "content array<struct<text:string,toolUse:struct<toolUseId:string,name:string,input:string>,toolResult:struct<toolUseId:string,status:string,content:array<struct<text:string>>>>>")
    flat = blocks.select(traces.flatten_message(F.col("content")).alias("m")).first().m
    assert (flat.text, flat.tool_uses[0]["name"], flat.tool_results) == ("a\nb", "f", [])
    assert one(spark, text.prompt_file(F.lit("memory-on"), F.lit(True))) == "memory-on-tools.md"
    legs = spark.createDataFrame([(1, 0, 0, "d", 0.2), (1, 1, 0, "d", 0.8)], "event_id int, leg_idx int, pos int, day string, p double")
    winners = spark.createDataFrame([(1, 1)], "event_id int, leg_idx int")
    assert dates.crowd_of_winner(legs, winners).first().crowd == 0.8
    days = spark.createDataFrame([(1, 1, "2025-01-02", 0), (1, 0, "2025-01-01", 5)], "event_id int, pos int, day string, news int")
    assert volume.nest(days).first().news_daily == [5, 0]
    tags = spark.createDataFrame([(1, "zz"), (1, "zz"), (2, "yy")], "event_id int, tag string")
    assert [(r.name, r.n) for r in taxonomy.top_unmapped(tags, spark.createDataFrame([("a", "tech")], "tag string, domain string"), 1).collect()] == [("zz", 2)]


def test_episode_build(spark):
    schema = "event_id int, slug string, title string, body string, start_date string, close_date string, belief_kind string, resolved_label string, markets array<struct<label:string,question:string,market_id:string,closed_time:string>>"
    questions = spark.createDataFrame([(1, "s", "T", " b ", "2025-01-01T0", "2025-02-01T0", "binary", "yes", None), (2, "s", "T", None, "2025-01-01", None, "multi_neg_risk", "A", [("A", None, "1", None)])], schema)
    picked = spark.createDataFrame([(1, "2025-01-05", 0.5), (2, "2025-01-06", None)], "event_id int, day string, crowd double")
    domains = spark.createDataFrame([(1, "tech")], "event_id int, domain string")
    rows = {r.event_id: r for r in episodes.build(questions, picked, domains, "memory-free").collect()}
    assert (rows[1].label, rows[1].prompt, rows[1].question.close_date, rows[1].question.markets, rows[1].forecast_date) == ("YES", "Forecast: T", "2025-02-01", None, "2025-01-05")
    assert rows[2].question.markets[0].question == "" and rows[2].crowd_prob is None
    assert episodes.build(questions, picked, domains, start="2024-12-01").first().start_date == "2024-12-01"


def test_json_lines_end_with_their_object(spark, tmp_path):
    """The check of a line agrees with Python's reader; the strict reader raises, the lenient ones drop."""
    lines = [
        '{"event_id":"b"}', '{"event_id":"b"} junk', '{"a":1}, {"b":2}', '{"a":1}] x', '{"a":NaN}', "{'a':1}", '{"a":1,"a":2}', "[1]", '"x"', "1", '{"a":1,}', "{a:1}", "",
        '{"a":01}', ' {"a":{"b":[1,{"c":"]"}]}} ', '{"a":1}{"b":2}', '{"a":"\\\\ud800"}', '{"a":"tab\t"}', "{} ", '{"a":"\\\\x"}', '/*c*/{"a":1}', '{"a":+1}', '{"a":.5}', "null", '{"event_id":',
    ]

    def reads(line):
        try:
            return isinstance(json.loads(line), dict)
        except ValueError:
            return False

    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.ok for r in df.select(files.json_object("value").alias("ok")).collect()] == [reads(x) for x in lines]
    good = tmp_path / "good.jsonl"
    good.write_text('{"event_id":"b","rollout_idx":1}\n\n  \n{"event_id":"c","rollout_idx":2,"error":null}\n')
    assert sorted(r.event_id for r in files.strict_json(spark, str(good), files.RESULT).collect()) == ["b", "c"]
    assert sorted((r.event_id, r.has_error) for r in files.results(spark, str(good)).collect()) == [("b", False), ("c", True)]
    for tail in ('{"event_id":"b"} junk', '{"event_id":"b"}{"event_id":"c"}', "{'event_id':'b'}", '{"event_id":'):
        bad = tmp_path / "bad.jsonl"
        bad.write_text('{"event_id":"a"}\n' + tail + "\n")
        for read in (files.questions, lambda s, p: files.strict_json(s, p, files.EPISODE)):
            with pytest.raises(Exception, match="malformed JSON line"):
                read(spark, str(bad)).select("event_id").collect()
        assert [r.event_id for r in files.results(spark, str(bad)).collect()] == ["a"]
        assert [r.event_id for r in files.completed(spark, str(bad)).collect()] == ["a"]
        assert [r.event_id for r in files.lenient_json(spark, str(bad), files.RESULT).collect()] == ["a"]


def test_news_of_another_length_counts_as_zeros(spark):
    days = F.array(F.lit("d1"), F.lit("d2"))
    series = lambda *x: one(spark, dates.aligned_news(days, F.array(*[F.lit(v).cast("long") for v in x])))
    assert series(3, 4) == [3.0, 4.0] and series(3) == [0.0, 0.0] and series(3, 4, 5) == [0.0, 0.0] and series(None, 4) == [0.0, 4.0]
    assert one(spark, dates.aligned_news(days, F.lit(None).cast("array<bigint>"))) == [0.0, 0.0]


def test_named_objects():
    from tidemark.sources import loader

    assert loader.named_class("tidemark.functions.rewards.ProperScore").__name__ == "ProperScore"
    assert loader.named_object("json.loads") is json.loads
    for path in ("loads", "json.nothing", "no.such.module.name", "math.pi"):
        with pytest.raises(ValueError):
            loader.named_object(path)
    with pytest.raises(ValueError):
        loader.named_class("json.loads")


def test_best_of_tile_equals_sorting():
    import numpy as np

    draw = np.random.default_rng(3)
    for n in (1, 4, 5, 40):
        score = np.round(draw.random((6, n)), 1)
        score[draw.random((6, n)) < 0.2] = -np.inf
        article = draw.permutation(n)
        q, j = retrieval.best_of_tile(score, article, 5)
        expected = [(r, int(c)) for r in range(6) for c in sorted(range(n), key=lambda c: (-score[r, c], article[c]))[:5] if score[r, c] > -np.inf]  # noqa: B023
        assert list(zip(q.tolist(), j.tolist(), strict=True)) == expected


def test_search_in_many_blocks_of_queries(spark):
    rows = [(i, f"2024-01-{1 + i % 28:02d}", [float(i % 7), float(i % 5), 1.0]) for i in range(300)]
    articles = spark.createDataFrame(rows, "article_id long, published_date string, embedding array<double>")
    asked = articles.filter("article_id % 3 = 0").select(F.col("article_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("cutoff"))
    whole = retrieval.search(articles, asked).collect()
    parts = retrieval.search(articles, asked, query_block=20).collect()
    assert len(whole) == 500 and sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_positions_number_all_rows(spark):
    rows = [(i, [f"2024-01-{1 + i % 9:02d}", f"2024-02-{1 + i % 4:02d}"], i) for i in range(200)] + [(500, None, 500)]
    df = spark.createDataFrame(rows, "event_id long, forecast_dates array<string>, input_pos long").repartition(3)
    got = {r.event_id: r.position for r in episodes.positions(df, "entry").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or [], str(r[0])))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
