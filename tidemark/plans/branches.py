"""Queries whose rows take the rarer ways through the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, scores
from ..operators import dates, episodes, evaluation, taxonomy, traces
from ..sources import files, positions, sinks
from ..sources.scratch import scratch
from . import views as v
from .registry import query
from .views import table

_NAMED = """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_type, event_id) AS place, event_id % 5 > 0 AS ok, value / 1000 AS brier FROM events),
  f AS (SELECT event_id FROM r ORDER BY place LIMIT 1)"""


@query(f"""{_NAMED} SELECT 'run ' || (SELECT event_id FROM f) AS run_id, CASE WHEN (SELECT event_id FROM f) % 2 = 0 THEN 'model' END AS model_name, count(*) AS n_rows, count(*) FILTER (ok) AS n_scored,
  count(*) FILTER (NOT ok) AS n_errors, round(avg(round(brier, 6)) FILTER (ok), 6) AS brier FROM r""")
def scorecard_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card of a log of several files: run and model are those of its first line, null where that has none."""
    e = table(spark, sf_dir, "events")
    record = F.struct(
        F.concat(F.lit("run "), "event_id").alias("run_id"), F.when(F.col("event_id") % 2 == 0, "model").alias("model_name"), F.round(F.col("value") / 1000, 6).alias("brier"),
        F.lit(True).alias("parse_ok"), F.when(F.col("event_id") % 5 == 0, "lost").alias("error"),
    )
    path = f"{scratch(spark)}/log"
    sinks.ordered_lines(e.select("event_type", "event_id", record.alias("r")), ["event_type", "event_id"], path, 4)
    lines = positions.numbered_lines(spark, path).withColumn("value", F.get_json_object("value", "$.r"))
    card = evaluation.scorecard(files.result_rows(lines), position="position")
    return card.select("run_id", "model_name", "n_rows", "n_scored", "n_errors", F.round("brier", 6).alias("brier"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'missing_truth' END AS error, CASE event_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN round(-2 * (event_id % 100 / 100.0) ** 2, 6) ELSE -2.0 END AS reward,
  CASE WHEN event_id % 3 > 0 THEN event_id % 3 = 1 END AS parse_ok FROM events""")
def missing_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a truth (null, blank or ``?``) the reward is zero and nothing else is told; without an answer it is the worst."""
    e = table(spark, sf_dir, "events")
    none = F.element_at(F.array(F.lit(None).cast("string"), F.lit("  "), F.lit("?")), (F.floor(F.col("event_id") / 3) % 3 + 1).cast("int"))
    truth = F.when(F.col("event_id") % 3 == 0, none).otherwise("YES")
    p = F.col("event_id") % 100 / 100.0
    forecast = F.when(F.col("event_id") % 3 != 2, F.create_map(F.lit("YES"), 1.0 - p, F.lit("NO"), p))
    scored = scores.score(forecast, truth, F.lit(None).cast("double"), F.lit(1.0), "brier")
    return e.select("event_id", scored.alias("s")).select("event_id", "s.error", F.round("s.reward", 6).alias("reward"), "s.parse_ok")


_KINDS = """t AS (SELECT conv_id, turn, conv_id % 6 AS kind, conv_id % 4 AS note FROM conversations WHERE role = 'assistant'),
  q AS (SELECT *, (CASE WHEN kind IN (0, 3) THEN 1 ELSE 0 END + CASE WHEN kind < 4 THEN 1 ELSE 0 END + CASE WHEN kind IN (0, 1, 2) THEN 1 ELSE 0 END) / 3.0 AS answer_ok,
    (CASE WHEN note < 3 THEN 1 ELSE 0 END + CASE WHEN note < 2 THEN 1 ELSE 0 END + CASE WHEN note = 0 AND kind < 3 THEN 1 ELSE 0 END) / 3.0 AS notebook_ok FROM t)"""


@query(f"WITH {_KINDS} SELECT conv_id, turn, round(answer_ok, 6) AS answer_ok, round(notebook_ok, 6) AS notebook_ok, round(0.5 * answer_ok + 0.5 * notebook_ok, 6) AS format_quality FROM q")
def format_quality_memory_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and notebooks scored half and half: notebooks agree, differ, lack probabilities or can't be read."""
    kind, note = F.col("conv_id") % 6, F.col("conv_id") % 4
    strict, other = '{"YES": 0.25, "NO": 0.75}', '{"YES": 0.6, "NO": 0.4}'
    said = F.when(kind == 1, strict.replace('"', "")).when(kind == 2, strict.replace('"', "'")).when(kind == 3, '{"YES": 0.25, "NO": 0.25}').when(kind == 4, '{"YES"').otherwise(F.lit(strict))
    noted = F.when(note == 0, f'{{"assessment": {{"p": {strict}}}}}').when(note == 1, f'{{"assessment": {{"p": {other}}}}}').when(note == 2, '{"assessment": {}}').otherwise("{broken")
    shown = F.concat(F.when(kind < 5, F.concat(F.lit("<answer>"), said, F.lit("</answer>"))).otherwise(""), F.lit("<belief_notebook>"), noted, F.lit("</belief_notebook>"))
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.concat("text", shown).alias("text"))
    rows = rows.select("conv_id", "turn", answers.answer("text").alias("a"), answers.notebook("text").alias("n"))
    answer = scores.answer_quality(F.col("a.strict_json"), F.col("a.all_numeric"), F.coalesce(scores.raw_sum("a.forecast"), F.lit(0.0)))
    notebook = scores.notebook_quality(F.col("n.parseable"), F.col("n.has_assessment_p"), scores.same_distribution(F.col("a.forecast"), F.col("n.p")))
    rows = rows.select("conv_id", "turn", answer.alias("answer_ok"), notebook.alias("notebook_ok"))
    return rows.select("conv_id", "turn", F.round("answer_ok", 6).alias("answer_ok"), F.round("notebook_ok", 6).alias("notebook_ok"), F.round(scores.format_quality(F.col("answer_ok"), F.col("notebook_ok")), 6).alias("format_quality"))


@query("""WITH q AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey % 2 = 0 AS yes FROM customer), d AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT c_custkey AS event_id, CASE WHEN yes THEN 'binary' ELSE 'multi' END AS belief_kind, CASE WHEN yes THEN CASE WHEN c_custkey % 4 = 0 THEN 'YES' ELSE 'NO' END ELSE 'leg' END AS label,
  'Forecast: ' || c_name AS prompt, '2024-01-01' AS start_date, trim(c_mktsegment) AS body, CASE WHEN c_custkey % 3 > 0 THEN '2024-06-01' ELSE '' END AS close_date, CASE WHEN NOT yes THEN 'a,leg' END AS legs,
  CASE WHEN c_custkey % 5 > 0 THEN 'tech' END AS domain, day AS forecast_date, CASE WHEN n % 2 = 1 THEN 0.5 END AS crowd_prob FROM q JOIN d ON o_custkey = c_custkey""")
def episode_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with truth, payload, domain and dates: binary labels in capitals, legs only of the others, no row without a date."""
    c = table(spark, sf_dir, "customer")
    yes = F.col("c_custkey") % 2 == 0
    label = F.when(yes, F.when(F.col("c_custkey") % 4 == 0, " yes").otherwise("No ")).otherwise(" leg")
    legs = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(None).cast("string").alias("question")) for x in ("a", "leg")])
    questions = c.select(
        F.col("c_custkey").alias("event_id"), F.col("c_name").alias("slug"), F.col("c_name").alias("title"), F.concat(F.lit(" "), "c_mktsegment", F.lit("\n")).alias("body"), F.when(yes, "binary").otherwise("multi").alias("belief_kind"),
        label.alias("resolved_label"), F.lit("2024-01-01T00:00:00Z").alias("start_date"), F.when(F.col("c_custkey") % 3 > 0, "2024-06-01T12:00:00").alias("close_date"), legs.alias("markets"),
    )
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.when(F.count("*") % 2 == 1, 0.5).alias("crowd"))
    domains = c.filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("event_id"), F.lit("tech").alias("domain"))
    rows = episodes.build(questions, days, domains, "memory-free")
    shown = F.array_join(F.transform("question.markets", lambda m: m["label"]), ",")
    return rows.select("event_id", "belief_kind", "label", "prompt", "start_date", F.trim(F.regexp_replace("question.body", "\n", "")).alias("body"), "question.close_date", shown.alias("legs"), "domain", "forecast_date", "crowd_prob")


@query(f"""WITH {v.LEG_SHARE}, w AS (SELECT event_id, day, p FROM leg_share WHERE leg = (['click', 'error', 'purchase', 'signup', 'view'])[CAST(event_id % 6 AS INTEGER) + 1])
SELECT d.event_id, d.day, round(w.p, 8) AS crowd FROM (SELECT DISTINCT event_id, day FROM leg_share) d LEFT JOIN w USING (event_id, day)""")
def crowd_of_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning leg's series by its index among the legs; an index beyond them has none."""
    legs = v.leg_share(spark, sf_dir).withColumn("leg_idx", F.array_position(F.array(*[F.lit(x) for x in v.LEGS]), F.col("leg")) - 1)
    events = legs.select("event_id").distinct().select("event_id", (F.col("event_id") % 6).alias("leg_idx"))
    days = legs.select("event_id", "day").distinct()
    return dates.crowd_for_dates(days, dates.crowd_of_winner(legs, events)).select("event_id", "day", F.round("crowd", 8).alias("crowd"))


_TRACE = """m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text FROM conversations WHERE role IN ('assistant', 'user')),
  k AS (SELECT *, role = 'assistant' AND pos % 2 = 0 AS uses, role = 'user' AND pos % 3 = 0 AS told FROM m)"""


@query(f"""WITH {_TRACE} SELECT conv_id, CAST(pos AS INTEGER) AS pos, role, CASE WHEN role = 'assistant' OR told THEN CAST(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) ELSE 0 END AS turn,
  md5(CASE WHEN told THEN '' ELSE text || chr(10) || 'more' END) AS text_md5, CASE WHEN uses THEN 'search#t' || pos ELSE '' END AS uses, CASE WHEN told THEN CASE WHEN pos % 2 = 0 THEN 'error' ELSE 'success' END || '#' || md5(text || chr(10) || 'tail') ELSE '' END AS told FROM k""")
def trace_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages stored as JSON blocks: texts are joined, tool uses named, tool results numbered with the turn that asked."""
    m = table(spark, sf_dir, "conversations").filter("role in ('assistant', 'user')")
    m = m.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    told, uses = (F.col("role") == "user") & (F.col("pos") % 3 == 0), (F.col("role") == "assistant") & (F.col("pos") % 2 == 0)
    text = lambda x: F.struct(x.alias("text"))
    plain = F.array(F.to_json(text(F.col("text"))), F.to_json(text(F.lit("more"))))
    use = F.to_json(F.struct(F.struct(F.concat(F.lit("t"), "pos").alias("toolUseId"), F.lit("search").alias("name")).alias("toolUse")))
    status = F.when(F.col("pos") % 2 == 0, "error")
    result = F.to_json(F.struct(F.struct(status.alias("status"), F.array(text(F.col("text")), text(F.lit(None).cast("string")), text(F.lit("tail"))).alias("content")).alias("toolResult")))
    blocks = F.when(told, F.array(result)).when(uses, F.array_append(plain, use)).otherwise(plain)
    stored = m.select("conv_id", "pos", "role", F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]")).alias("content"))
    flat = traces.full_trace(stored.withColumn("content", F.from_json("content", traces.BLOCKS)))
    named = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit("#"), b(x))), ",")
    return flat.select(
        "conv_id", "pos", "role", "turn", F.md5("text").alias("text_md5"), named("tool_uses", "name", lambda x: x["id"]).alias("uses"), named("tool_results", "status", lambda x: F.md5(x["text"])).alias("told"),
    )


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, CASE WHEN vec_id % 9 = 0 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) END AS u FROM e)
SELECT vec_id, round(list_inner_product(u, u), 6) + 0.0 AS length, round(list_inner_product(u, v), 6) + 0.0 AS score FROM u""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to unit length, every ninth of them a zero vector, and the inner product with what they were."""
    e = table(spark, sf_dir, "embeddings")
    given = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    rows = e.select("vec_id", "embedding", scores.unit(given).alias("u"))
    return rows.select("vec_id", (F.round(scores.inner_product("u", "u"), 6) + 0.0).alias("length"), (F.round(scores.inner_product("u", "embedding"), 6) + 0.0).alias("score"))


@query(f"""WITH {v.TAGS}, d(tag) AS (VALUES {", ".join(f"('{t}')" for ws in v.DICTIONARY.values() for t in ws)}), n AS (SELECT tag AS name, count(*) AS n FROM tags WHERE tag <> 'new' AND tag NOT IN (SELECT tag FROM d) GROUP BY 1)
SELECT name, n, CAST(row_number() OVER (ORDER BY n DESC, name) AS INTEGER) AS rank FROM n QUALIFY rank <= 4""")
def top_unmapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.top_unmapped(v.tags(spark, sf_dir), v.dictionary(spark), 4).select("name", "n", "rank")


@query("""WITH m AS (SELECT p_partkey AS event_id, list_concat(list_concat(CASE WHEN p_partkey % 3 < 2 THEN ['new'] ELSE [] END, string_split(p_name, ' ')), CASE WHEN p_partkey % 3 = 0 THEN ['march-7'] ELSE [] END) AS t FROM part)
SELECT event_id, array_to_string(list_filter(t, lambda x: x NOT IN ('new', 'march-7')), ',') AS topical, array_to_string(list_filter(t, lambda x: x IN ('new', 'march-7')), ',') AS flags FROM m""")
def tag_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing flags and topical tags of one list, both in order."""
    extra = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("new"), F.lit("march-7"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>"))
    words = F.split("p_name", " ")
    mixed = F.concat(F.slice(extra, 1, 1), words, F.slice(extra, 2, 1))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("event_id"), taxonomy.split_tags(mixed).alias("s"))
    return rows.select("event_id", F.array_join("s.topical", ",").alias("topical"), F.array_join("s.flags", ",").alias("flags"))


@query("SELECT c_custkey::VARCHAR AS event_id, strftime(DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER), '%Y-%m-%d') AS forecast_date, CASE WHEN c_custkey % 2 = 0 THEN 0.25 END AS crowd_prob FROM customer")
def single_date_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one date each, from a file without blank lines, decoded to lists of one."""
    meta = F.struct(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")), "yyyy-MM-dd").alias("forecast_date"), F.when(F.col("c_custkey") % 2 == 0, 0.25).alias("crowd_prob"))
    path = f"{scratch(spark)}/rows"
    sinks.episodes(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("event_id"), meta.alias("metadata")), path)
    read = files.unbroken_json(spark, path, files.EPISODE).select("event_id", "metadata.forecast_date", "metadata.crowd_prob")
    lists = episodes.decode(episodes.check_mode(read, "memory-free"))
    return lists.select("event_id", F.element_at("forecast_dates", 1).alias("forecast_date"), F.element_at("crowd_probs", 1).alias("crowd_prob"))
