"""One query per operator over the driver's tables; ``SQL`` has the same in DuckDB's dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, scores, text
from ..operators import advantage, curation, dates, episodes, evaluation, metrics, rendering, retrieval, sampling, taxonomy, traces, vector_index, volume, window_join
from ..sources.scratch import scratch, staged
from ..streaming import state
from . import branches as branches  # registers its queries
from . import placed as placed
from . import records as records
from . import views as v
from .registry import QUERIES as QUERIES
from .registry import SQL as SQL
from .registry import query
from .views import table

@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def news_volume_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.daily_volume(v.corpus(spark, sf_dir))


@query("SELECT count(*) AS articles, count(*) FILTER (event_id % 4 = 1 AND event_id // 4 % 4 <> 2) AS undated FROM events")
def news_volume_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth article has an odd day: none, an empty one, words, or one that no calendar has, which by its form is a day."""
    odd = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("2024-02-31"), F.lit("last May")), (F.floor(F.col("event_id") / 4) % 4 + 1).cast("int"))
    day = F.when(F.col("event_id") % 4 == 1, odd).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return volume.volume_totals(table(spark, sf_dir, "events").select(day.alias("published_date")))


@query("SELECT min(strftime(ts, '%Y-%m')) || '-01' AS start FROM events")
def earliest_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.earliest_shard(v.corpus(spark, sf_dir))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dates.belief_delta_binary(v.daily_belief(spark, sf_dir))
    rows = volume.attach(rows.drop("n"), volume.daily_volume(v.corpus(spark, sf_dir)))
    return rows.withColumn("resolution", F.lit(v.RESOLUTION).cast("date"))


_DELTA = f"WITH {v.DAILY_BELIEF}, {v.VOLUME}, delta AS (SELECT event_id, pos, day, coalesce(abs(p - lag(p) OVER (PARTITION BY event_id ORDER BY pos)), 0.0) AS delta FROM daily_belief)"
_SELECT = f"""{_DELTA}, s AS (SELECT d.*, CASE WHEN max(delta) OVER e > 0 THEN delta / max(delta) OVER e ELSE 0.0 END AS belief,
    CASE WHEN max(coalesce(v.n, 0)) OVER e > 0 THEN CAST(coalesce(v.n, 0) AS DOUBLE) / max(coalesce(v.n, 0)) OVER e ELSE 0.0 END AS vol
    FROM delta d LEFT JOIN volume v ON v.day = d.day WINDOW e AS (PARTITION BY d.event_id)),
  f AS (SELECT *, date_diff('day', CAST(day AS DATE), DATE '{v.RESOLUTION}') >= 2 AS fits FROM s),
  p AS (SELECT *, bool_or(fits) OVER (PARTITION BY event_id) AS any_fits FROM f),
  q AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS t FROM p WHERE fits OR NOT any_fits),
  k AS (SELECT *, CASE WHEN n < 1 THEN 3 ELSE CAST(least(greatest(round_even(1.0 * sqrt(n), 0), 3), 10) AS BIGINT) END AS k FROM q),
  w AS (SELECT *, round(0.7 * belief + (1.0 - 0.7) * vol + 0.001 * (t / greatest(n - 1, 1)), 9) AS weight,
    CASE WHEN n <= k THEN t ELSE ((t + 1) * k - 1) // n END AS bin FROM k),
  picked AS (SELECT event_id, bin, pos, day, weight FROM w QUALIFY row_number() OVER (PARTITION BY event_id, bin ORDER BY weight DESC, t DESC) = 1)"""


@query(f"{_SELECT} SELECT event_id, CAST(bin AS BIGINT) AS bin, CAST(pos AS INTEGER) AS pos, day, weight FROM picked")
def select_forecast_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.select_dates(_signals(spark, sf_dir))


@query(f"{_SELECT} SELECT event_id, CAST(bin AS BIGINT) AS bin, day, weight FROM picked")
def stream_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that arrive as a stream in two goes and out of order: each bin of the horizon tells its best day once it is complete."""
    folder = scratch(spark)
    pool = staged(dates.weigh_dates(_signals(spark, sf_dir)).select("event_id", "day", "t", "n", "k", "bin", "weight"))
    for part in (0, 1):
        pool.filter(F.pmod(F.xxhash64("event_id", "day"), F.lit(2)) == part).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        days = spark.readStream.schema(pool.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        state.dates_by_bin(days, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "bin", "day", "weight")


@query(f"{_DELTA} SELECT event_id, CAST(pos AS INTEGER) AS pos, day, round(delta, 8) AS delta FROM delta")
def belief_delta_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.belief_delta_binary(v.daily_belief(spark, sf_dir)).select("event_id", "pos", "day", F.round("delta", 8).alias("delta"))


@query(f"""WITH {v.LEG_SHARE}, s AS (SELECT event_id, pos, abs(p - lag(p) OVER (PARTITION BY event_id, leg ORDER BY pos)) AS step FROM leg_share)
SELECT event_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN count(step) = count(*) THEN sum(step) * 0.5 ELSE 0.0 END, 8) AS delta FROM s GROUP BY event_id, pos""")
def belief_delta_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.belief_delta_multi(v.leg_share(spark, sf_dir)).select("event_id", "pos", F.round("delta", 8).alias("delta"))


def _crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.daily_belief(spark, sf_dir).withColumn("resolved_label", F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("?")), (F.col("event_id") % 3 + 1).cast("int")))
    return dates.crowd_on_truth(rows)


_CROWD = f"{_SELECT}, crowd AS (SELECT event_id, day, CASE event_id % 3 WHEN 0 THEN p WHEN 1 THEN 1.0 - p END AS crowd FROM daily_belief)"


@query(f"{_CROWD} SELECT p.event_id, p.day, round(c.crowd, 8) AS crowd FROM picked p LEFT JOIN crowd c USING (event_id, day)")
def crowd_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = dates.select_dates(_signals(spark, sf_dir)).select("event_id", "day")
    return dates.crowd_for_dates(chosen, _crowd(spark, sf_dir)).select("event_id", "day", F.round("crowd", 8).alias("crowd"))


@query(f"WITH {v.DAILY_BELIEF}, {v.VOLUME} SELECT d.event_id, d.day, CAST(d.pos AS INTEGER) AS pos, coalesce(v.n, 0) AS news FROM daily_belief d LEFT JOIN volume v USING (day)")
def attach_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.attach(v.daily_belief(spark, sf_dir), volume.daily_volume(v.corpus(spark, sf_dir))).select("event_id", "day", "pos", "news")


@query("SELECT count(DISTINCT user_id) AS events_with_news FROM events")
def volume_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.overlapping(attach_volume(spark, sf_dir))


_VOTES = f"""WITH {v.TAGS}, dictionary(tag, domain) AS (VALUES {", ".join(f"('{t}', '{d}')" for d, ws in v.DICTIONARY.items() for t in ws)}),
  priority(domain, priority) AS (VALUES {", ".join(f"('{d}', {i})" for i, d in enumerate(taxonomy.PRIORITY))}),
  topical AS (SELECT * FROM tags WHERE tag <> 'new'),
  votes AS (SELECT event_id, domain, count(*) AS votes FROM topical JOIN dictionary USING (tag) GROUP BY 1, 2),
  classes AS (SELECT e.event_id, coalesce(b.domain, 'unknown') AS domain, coalesce(b.domains, []) AS domains FROM (SELECT DISTINCT event_id FROM tags) e
    LEFT JOIN (SELECT event_id, arg_max(domain, votes * 100 - priority) AS domain, list(domain ORDER BY priority) AS domains
      FROM votes JOIN priority USING (domain) GROUP BY 1) b USING (event_id))"""


@query(f"{_VOTES} SELECT * FROM votes")
def domain_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.votes(v.tags(spark, sf_dir), v.dictionary(spark))


@query(f"{_VOTES} SELECT event_id, domain, array_to_string(domains, ',') AS domains FROM classes")
def classify_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.classify(v.tags(spark, sf_dir), v.dictionary(spark)).withColumn("domains", F.array_join("domains", ","))


@query(f"""{_VOTES} SELECT 'events' AS kind, '' AS name, count(*) AS n FROM classes UNION ALL SELECT 'unresolved', '', count(*) FROM classes WHERE domain = 'unknown'
UNION ALL SELECT 'domain', domain, count(*) FROM classes WHERE domain <> 'unknown' GROUP BY 2
UNION ALL SELECT 'unmapped', tag, count(*) FROM topical WHERE tag NOT IN (SELECT tag FROM dictionary) GROUP BY 2""")
def audit_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.audit(v.tags(spark, sf_dir), v.dictionary(spark))


@query("""SELECT tag, count(DISTINCT domain) AS domains FROM (SELECT unnest(string_split(p_name, ' ')) AS tag, p_brand AS domain FROM part UNION ALL SELECT p_type, 'one' FROM part)
GROUP BY 1 HAVING count(DISTINCT domain) > 1""")
def ambiguous_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name words claimed by several makers; types, which one domain claims however often, are no clash."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("tag"), F.col("p_brand").alias("domain"))
    return taxonomy.ambiguous_tags(words.unionAll(part.select(F.col("p_type").alias("tag"), F.lit("one").alias("domain"))))


def _leg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brands as legs: every fifth is a reserved slot, traded in only if its size is even."""
    slot = F.concat(F.lit("Player "), F.element_at(F.array(*[F.lit(x) for x in "ABCDEFG"]), (F.col("p_partkey") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 8).alias("event_id"), F.when(F.col("p_partkey") % 5 == 0, slot).otherwise(F.col("p_name")).alias("label"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).otherwise(0.0).alias("notional"), (F.col("p_partkey") % 8 == 3).alias("resolved"), F.col("p_partkey").alias("leg"),
    )


@query("""WITH legs AS (SELECT p_partkey // 8 AS event_id, p_partkey AS leg, CASE WHEN p_partkey % 5 = 0 THEN 'Player ' || substr('ABCDEFG', CAST(p_partkey % 7 AS INTEGER) + 1, 1) ELSE p_name END AS label,
    CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE 0.0 END AS notional, p_partkey % 8 = 3 AS resolved FROM part),
  m AS (SELECT *, regexp_full_match(label, '[A-Z][a-z]+ [A-Z]') AND notional <= 0 AS slot FROM legs)
SELECT event_id, leg, label, notional, resolved FROM m WHERE NOT slot AND event_id IN
  (SELECT event_id FROM m GROUP BY 1 HAVING NOT bool_or(slot AND resolved) AND count(*) FILTER (NOT slot) >= 2)""")
def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.filter_legs(_leg_rows(spark, sf_dir)).select("event_id", "leg", "label", "notional", "resolved")


@query("""SELECT event_id, CAST(num_markets AS INTEGER) AS num_markets FROM (
  WITH legs AS (SELECT p_partkey // 8 AS event_id, CASE WHEN p_partkey % 5 = 0 THEN 'Player ' || substr('ABCDEFG', CAST(p_partkey % 7 AS INTEGER) + 1, 1) ELSE p_name || ' ' || p_partkey END AS label,
    p_partkey % 5 = 0 AND p_size % 2 = 1 AS slot, p_partkey % 8 = 3 AS resolved FROM part)
  SELECT event_id, count(*) FILTER (NOT slot) AS num_markets FROM legs GROUP BY 1 HAVING NOT bool_or(slot AND resolved) AND count(*) FILTER (NOT slot) >= 2)""")
def placeholder_filter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = _leg_rows(spark, sf_dir).withColumn("label", F.when(F.col("leg") % 5 == 0, F.col("label")).otherwise(F.concat_ws(" ", "label", "leg")))
    market = F.struct("label", F.lit("").alias("question"), F.col("leg").cast("string").alias("market_id"), F.lit(None).cast("string").alias("closed_time"))
    traded = F.struct(F.col("leg").cast("string").alias("k"), F.array(F.struct(F.col("notional").alias("notional"))).alias("v"))
    nested = legs.groupBy("event_id").agg(
        F.collect_list(market).alias("markets"), F.map_from_entries(F.collect_list(traded)).alias("daily_volume_by_market"),
        F.max(F.when(F.col("resolved"), F.col("label"))).alias("resolved_label"), F.count("*").cast("int").alias("num_markets"),
    )
    return curation.filter_questions(nested.withColumn("belief_kind", F.lit(curation.MULTI))).select("event_id", "num_markets")


_EPISODES = f"""{_CROWD}, c AS (SELECT p.event_id, p.day, round(c.crowd, 8) AS crowd FROM picked p LEFT JOIN crowd c USING (event_id, day))"""


def _memory_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.memory_on(crowd_probability(spark, sf_dir))


@query(f"""{_EPISODES} SELECT event_id, array_to_string(list(day ORDER BY day), ',') AS forecast_dates, count(*) AS n_dates, round(sum(crowd), 6) AS crowd_sum FROM c GROUP BY 1""")
def episode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memory_on(spark, sf_dir)
    total = F.when(F.exists("crowd_probs", lambda x: x.isNotNull()), F.round(scores.total(F.col("crowd_probs")), 6))
    return rows.select("event_id", F.array_join("forecast_dates", ",").alias("forecast_dates"), F.size("forecast_dates").cast("long").alias("n_dates"), total.alias("crowd_sum"))


@query(f"{_EPISODES} SELECT event_id, day AS forecast_date, crowd AS crowd_prob FROM c")
def episode_rows_memory_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.memory_free(_memory_on(spark, sf_dir))


@query(f"""{_EPISODES}, e AS (SELECT event_id, min(day) AS first, max(day) AS last FROM c GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY first, last, CAST(event_id AS VARCHAR)) AS INTEGER) AS position, event_id FROM e""")
def episode_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memory_on(spark, sf_dir).withColumn("input_pos", F.col("event_id"))
    return episodes.positions(rows, "entry").select("position", "event_id")


@query(f"""{_EPISODES} SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY day) - 1 AS INTEGER) AS step_idx, day AS forecast_date, crowd AS crowd_prob FROM c""")
def episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.steps(_memory_on(spark, sf_dir))


@query(f"{_EPISODES} SELECT '2024-01-01' AS start, max(day) AS cutoff FROM c")
def window_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.window_hull(_memory_on(spark, sf_dir).withColumn("start_date", F.lit("2024-01-01")))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's leg shares as an answer, the most frequent leg of the next day id as truth."""
    legs = v.leg_share(spark, sf_dir)
    one = legs.groupBy("event_id", "day", "pos").agg(F.map_from_entries(F.collect_list(F.struct("leg", "p"))).alias("forecast"))
    truth = F.element_at(F.array(*[F.lit(x) for x in (*v.LEGS, "other")]), (F.col("event_id") % 6 + 1).cast("int"))
    crowd = F.when(F.col("pos") % 4 != 0, F.lit(0.25))
    return one.withColumns({"truth": truth, "crowd": crowd})


_SCORES = f"""WITH {v.LEG_SHARE}, f AS (SELECT event_id, day, pos, leg, p, (['click', 'error', 'purchase', 'signup', 'view', 'other'])[CAST(event_id % 6 AS INTEGER) + 1] AS truth FROM leg_share),
  g AS (SELECT event_id, day, pos, any_value(truth) AS truth, sum(p) AS mass, max(p) AS top, coalesce(max(p) FILTER (leg = truth), 0.0) AS pt FROM f GROUP BY 1, 2, 3),
  x AS (SELECT g.*, sum((f.p / g.mass - CASE WHEN f.leg = f.truth THEN 1.0 ELSE 0.0 END) ** 2) OVER w + CASE WHEN g.truth = 'other' THEN 1.0 ELSE 0.0 END AS brier,
    ln(greatest(0.001, least(1.0, g.pt / g.mass))) AS log_prob, count(*) FILTER (f.p = g.top) OVER w AS ties, row_number() OVER (PARTITION BY g.event_id, g.day ORDER BY f.leg) AS i
    FROM g JOIN f USING (event_id, day) WINDOW w AS (PARTITION BY g.event_id, g.day)),
  s AS (SELECT event_id, day, pos, brier, log_prob, CASE WHEN pt = top THEN 1.0 / ties ELSE 0.0 END AS accuracy, pt / mass AS p_truth,
    CASE WHEN pos % 4 <> 0 THEN log_prob - ln(0.25) END AS info_alpha FROM x WHERE i = 1)"""


def _scored(spark: SparkSession, sf_dir: str, metric: str = "brier") -> DataFrame:
    quality = scores.answer_quality(F.lit(True), F.lit(True), scores.raw_sum("forecast"))
    return _forecasts(spark, sf_dir).withColumn("s", scores.score(F.col("forecast"), F.col("truth"), F.col("crowd"), quality, metric))


@query(f"{_SCORES} SELECT event_id, day, round(brier, 6) AS brier, round(log_prob, 6) AS log_prob, round(accuracy, 6) AS accuracy, round(p_truth, 6) AS p_truth FROM s")
def score_brier_log_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", "day", *[F.round(f"s.{c}", 6).alias(c) for c in ("brier", "log_prob", "accuracy", "p_truth")])


@query(f"{_SCORES} SELECT event_id, day, round(info_alpha, 6) AS info_alpha FROM s")
def info_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", "day", F.round("s.info_alpha", 6).alias("info_alpha"))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers after the conversations' texts: strict, bare-keyed, literal, short of sum one, broken, absent."""
    yes = F.round(F.lit(0.05) * (F.col("conv_id") % 20), 2)
    no = F.round(1.0 - yes - F.when(F.col("conv_id") % 6 == 3, 0.2).otherwise(0.0), 2)
    body = F.format_string('{"YES": %.2f, "NO": %.2f}', yes, no)
    kind = F.col("conv_id") % 6
    shown = (
        F.when(kind == 1, F.regexp_replace(body, '"', "")).when(kind == 2, F.regexp_replace(body, '"', "'"))
        .when(kind == 4, F.lit('{"YES": ')).otherwise(body)
    )
    tagged = F.when(kind == 5, F.col("text")).otherwise(F.concat("text", F.lit("<answer>old<answer>"), shown, F.lit("</answer>")))
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", tagged.alias("text"), yes.alias("yes"), no.alias("no"))


_TAGGED = """WITH t AS (SELECT conv_id, turn, conv_id % 6 AS kind, round(0.05 * (conv_id % 20), 2) AS yes,
  round(1.0 - round(0.05 * (conv_id % 20), 2) - CASE WHEN conv_id % 6 = 3 THEN 0.2 ELSE 0.0 END, 2) AS no FROM conversations WHERE role = 'assistant')"""


@query(f"""{_TAGGED} SELECT conv_id, turn, kind <> 5 AS tag_present, kind IN (0, 3) AS strict_json, kind NOT IN (4, 5) AS all_numeric,
  CASE WHEN kind NOT IN (4, 5) THEN yes::DOUBLE END AS yes, CASE WHEN kind NOT IN (4, 5) THEN no::DOUBLE END AS no FROM t""")
def parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).select("conv_id", "turn", answers.answer("text").alias("a"))
    label = lambda k: F.try_element_at("a.forecast", F.lit(k))
    return rows.select("conv_id", "turn", "a.tag_present", "a.strict_json", "a.all_numeric", label("YES").alias("yes"), label("NO").alias("no"))


@query(f"""{_TAGGED} SELECT conv_id, turn, kind NOT IN (4, 5) AS parseable, kind NOT IN (4, 5) AS has_assessment_p FROM t""")
def parse_notebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.regexp_replace("text", r"(?s)<answer>old<answer>(.*)</answer>", '<belief_notebook>{"assessment": {"p": $1}}</belief_notebook>')
    rows = _tagged(spark, sf_dir).select("conv_id", "turn", answers.notebook(note).alias("n"))
    return rows.select("conv_id", "turn", "n.parseable", "n.has_assessment_p")


@query(f"""{_TAGGED}, q AS (SELECT *, (CASE WHEN kind IN (0, 3) THEN 1 ELSE 0 END + CASE WHEN kind NOT IN (4, 5) THEN 1 ELSE 0 END
    + CASE WHEN kind IN (0, 1, 2) THEN 1 ELSE 0 END) / 3.0 AS quality FROM t)
SELECT conv_id, turn, round(quality, 6) AS format_quality,
  round(CASE WHEN kind IN (4, 5) THEN -2.0 ELSE -2 * (1.0 - yes::DOUBLE / (yes + greatest(no, 0))) ** 2 END + quality - 1.0, 6) AS reward FROM q""")
def format_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _tagged(spark, sf_dir).select("conv_id", "turn", answers.answer("text").alias("a"))
    mass = F.coalesce(scores.raw_sum("a.forecast"), F.lit(0.0))
    quality = scores.answer_quality(F.col("a.strict_json"), F.col("a.all_numeric"), mass)
    rows = a.withColumn("s", scores.score(F.col("a.forecast"), F.lit("YES"), F.lit(None).cast("double"), quality, "brier"))
    return rows.select("conv_id", "turn", F.round("s.format_quality", 6).alias("format_quality"), F.round("s.reward", 6).alias("reward"))


@query(f"{_TAGGED} SELECT conv_id, turn, kind NOT IN (4, 5) AND abs(yes - round(yes + 0.04, 2)) <= 0.05 AS matches FROM t")
def notebook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir).select("conv_id", "turn", "yes", "no", answers.answer("text").alias("a"))
    other = F.create_map(F.lit("YES"), F.round(F.col("yes") + 0.04, 2), F.lit("NO"), F.col("no"))
    return rows.select("conv_id", "turn", scores.same_distribution(F.col("a.forecast"), other).alias("matches"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("event_id", "pos", "s.*")
    return rows.withColumns({"has_error": F.col("event_id") % 11 == 0, "parse_ok": F.col("pos") % 5 != 0})


@query(f"""{_SCORES}, r AS (SELECT *, event_id % 11 = 0 AS has_error, event_id % 11 <> 0 AND pos % 5 <> 0 AS ok FROM s)
SELECT count(*) AS n_rows, count(*) FILTER (ok) AS n_scored, count(*) FILTER (has_error) AS n_errors, round(avg(brier) FILTER (ok), 6) AS brier,
  round(-avg(log_prob) FILTER (ok), 6) AS log_loss, round(avg(accuracy) FILTER (ok), 6) AS accuracy, round(avg(info_alpha) FILTER (ok), 6) AS info_alpha,
  count(info_alpha) FILTER (ok) AS n_info_alpha FROM r""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = evaluation.scorecard(_records(spark, sf_dir))
    return card.withColumns({c: F.round(c, 6) for c in ("brier", "log_loss", "accuracy", "info_alpha")})


@query("""SELECT o_orderkey AS event_id, CAST(r.i AS INTEGER) AS rollout_idx FROM orders CROSS JOIN range(4) r(i)""")
def rollout_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rollout_units(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")), 4)


@query("""SELECT o_orderkey AS event_id, CAST(r.i AS INTEGER) AS rollout_idx FROM orders CROSS JOIN range(4) r(i)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber - 1 = r.i)""")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.nullif(F.col("l_linenumber") - 1, F.lit(0)).alias("rollout_idx"))
    return evaluation.remaining(rollout_units(spark, sf_dir), done)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", "text", (F.col("turn") % 4 == 2).alias("tool_result"))


@query("""SELECT conv_id, turn AS pos, role, CASE WHEN role = 'assistant' OR turn % 4 = 2 THEN a ELSE 0 END AS turn FROM (
  SELECT *, CAST(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS a FROM conversations WHERE role IN ('assistant', 'user'))""")
def trace_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.turns(_messages(spark, sf_dir)).select("conv_id", "pos", "role", "turn")


@query("""SELECT conv_id, CASE WHEN arg_max(role, turn) = 'assistant' THEN nullif(arg_max(text, turn), '') END AS response FROM conversations GROUP BY 1""")
def final_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.final_response(_messages(spark, sf_dir).withColumn("text", F.concat(F.lit("<think>so</think>\n"), "text")))


@query("""SELECT conv_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def message_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces.concatenated(_messages(spark, sf_dir))
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|")
    return rows.select("conv_id", F.size("messages").alias("n"), F.md5(joined).alias("digest"))


_ADVANTAGE = f"""WITH {v.REWARDS} SELECT group_index, pos, round(reward, 5) AS reward, round(CASE WHEN count(*) OVER g < 2 THEN 0.0 ELSE (reward - avg(reward) OVER g){{scale}} END, 9) AS advantage
FROM rewards WINDOW g AS (PARTITION BY group_index)"""


def _advantage(spark: SparkSession, sf_dir: str, scale: bool) -> DataFrame:
    rows = advantage.group_advantage(v.rewards(spark, sf_dir), scale)
    return rows.select("group_index", "pos", F.round("reward", 5).alias("reward"), F.round("advantage", 9).alias("advantage"))


@query(_ADVANTAGE.format(scale=" / (stddev_samp(reward) OVER g + 0.000001)"))
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _advantage(spark, sf_dir, True)


@query(_ADVANTAGE.format(scale=""))
def group_advantage_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _advantage(spark, sf_dir, False)


_FIELDS = ["brier", "p_truth", "accuracy"]
_SAMPLES = f"{v.REWARDS}, samples AS (SELECT *, l_discount AS brier, CASE WHEN l_tax > 0.01 THEN l_tax END AS p_truth, correct AS accuracy FROM rewards)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.rewards(spark, sf_dir).withColumns({"brier": F.col("l_discount"), "p_truth": F.when(F.col("l_tax") > 0.01, F.col("l_tax")), "accuracy": F.col("correct")})


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "min", "max", "median")})


@query(f"""WITH {_SAMPLES}, long AS (SELECT 'brier' AS field, CAST(brier AS DOUBLE) AS x FROM samples UNION ALL SELECT 'p_truth', p_truth FROM samples UNION ALL SELECT 'accuracy', accuracy FROM samples)
SELECT field, count(x) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(median(x), 6) AS median FROM long GROUP BY 1""")
def field_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.field_statistics(_samples(spark, sf_dir), _FIELDS))


@query(f"""WITH {_SAMPLES}, rows AS (SELECT *, unnest(list_distinct([l_returnflag, l_linestatus])) AS slice FROM samples),
  long AS (SELECT slice, 'brier' AS field, CAST(brier AS DOUBLE) AS x FROM rows UNION ALL SELECT slice, 'p_truth', p_truth FROM rows UNION ALL SELECT slice, 'accuracy', accuracy FROM rows),
  st AS (SELECT slice, field, count(x) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(median(x), 6) AS median FROM long GROUP BY 1, 2 HAVING count(x) >= 10)
SELECT st.*, max(n) OVER (PARTITION BY slice) AS n_samples, n_groups FROM st JOIN (SELECT slice, count(DISTINCT group_index) AS n_groups FROM rows GROUP BY 1) USING (slice) WHERE n_groups >= 2""")
def sliced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.sliced_statistics(_samples(spark, sf_dir), [F.col("l_returnflag"), F.col("l_linestatus")], _FIELDS, min_samples=10, min_groups=2))


@query(f"""WITH {v.REWARDS}, g AS (SELECT group_index, count(*) AS n, CAST(sum(correct) AS BIGINT) AS c FROM rewards GROUP BY 1), m AS (SELECT max(n) AS most FROM g),
  k AS (SELECT CAST(2 ** i AS BIGINT) AS k FROM range(40) r(i), m WHERE 2 ** i < most UNION SELECT most FROM m),
  p AS (SELECT k, n, c, CASE WHEN n - c < k THEN 1.0 ELSE 1.0 - list_product(list_transform(range(0, k), lambda i: (n - c - i)::DOUBLE / (n - i))) END AS p FROM g JOIN k ON n >= k)
SELECT k, round(avg(p), 6) AS pass_at_k, count(*) AS n_groups FROM p GROUP BY 1""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pass_at_k(v.rewards(spark, sf_dir)).withColumn("pass_at_k", F.round("pass_at_k", 6))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: errors fail, every seventh signup fails to parse."""
    e = table(spark, sf_dir, "events")
    ok = (F.col("value") < 80).cast("long")
    return e.select(
        F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("is_known"), F.lit(1).cast("long").alias("calls"), ok.alias("successes"),
        (1 - ok).alias("errors"), (F.col("value") / 100).alias("latency_s"), "event_id", "user_id", "value",
    )


_TOOLS = """WITH t AS (SELECT tool, bool_or(known) AS is_known, sum(calls) AS calls, sum(ok) AS successes, sum(bad) AS parse_errors FROM (
  SELECT event_type AS tool, event_type <> 'error' AS known, 1 AS calls, CASE WHEN value < 80 THEN 1 ELSE 0 END AS ok, CASE WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 1 ELSE 0 END AS bad FROM events
  UNION ALL SELECT 'ghost', false, 0, 0, 1 FROM events WHERE event_id % 7 = 1 AND event_type = 'view') GROUP BY 1)"""


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    bad = calls.filter("tool = 'signup' AND event_id % 7 = 0").select("tool", F.lit(1).cast("long").alias("n"))
    ghost = calls.filter("tool = 'view' AND event_id % 7 = 1").select(F.lit("ghost").alias("tool"), F.lit(1).cast("long").alias("n"))
    return metrics.tool_totals(calls, bad.unionAll(ghost))


@query(f"""{_TOOLS} SELECT tool, round(calls / (SELECT count(DISTINCT user_id) FROM events), 6) AS avg_calls, round(CASE WHEN calls > 0 THEN successes / calls ELSE 0.0 END, 6) AS success_rate,
  round(CASE WHEN calls + parse_errors > 0 THEN parse_errors / (calls + parse_errors) ELSE 0.0 END, 6) AS parse_error_rate FROM t""")
def tool_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct().count()
    rates = metrics.tool_rates(_totals(spark, sf_dir), users)
    return rates.select("tool", *[F.round(c, 6).alias(c) for c in ("avg_calls", "success_rate", "parse_error_rate")])


@query(f"""{_TOOLS} SELECT round(sum(CASE WHEN is_known THEN 0 ELSE calls END) / sum(calls), 6) AS name_error_rate, round(sum(successes) / sum(calls), 6) AS success_rate,
  round(sum(parse_errors) / sum(calls), 6) AS parse_error_rate, round(sum(CASE WHEN is_known THEN calls ELSE 0 END) / sum(calls), 6) AS quality FROM t""")
def tool_rates_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.global_rates(_totals(spark, sf_dir))
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


@query("""SELECT event_type AS tool, round(sum(value), 4) AS total, max(value) AS max, round(avg(value), 4) AS mean, min(value) AS min, count(*) AS n FROM events GROUP BY 1""")
def compute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = metrics.summary(_calls(spark, sf_dir).withColumn("step", F.col("event_id") % 5), ["tool", "step"])
    return metrics.merge_summaries(steps, ["tool"]).withColumn("total", F.round("total", 4))


@query("""SELECT l_returnflag AS name, round(avg(x), 6) AS mean, list_sort(list(x))[CAST(count(*) // 2 AS BIGINT) + 1] AS p50,
  list_sort(list(x))[least(count(*) - 1, count(*) * 95 // 100) + 1] AS p95, max(x) AS max, count(*) AS n FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("value"))
    return metrics.latency_summary(rows, "name").withColumn("mean", F.round("mean", 6))


def _query_vectors(spark: SparkSession, sf_dir: str, windowed: bool) -> DataFrame:
    """Every fiftieth vector asks for its neighbours, in a window of its own or in none."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    start = F.when(F.lit(windowed), F.date_format(F.date_add(F.lit("2024-01-05").cast("date"), (F.col("vec_id") % 40).cast("int")), "yyyy-MM-dd"))
    cutoff = F.when(F.lit(windowed), F.date_format(F.date_add(F.lit("2024-01-25").cast("date"), (F.col("vec_id") % 60).cast("int")), "yyyy-MM-dd"))
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), start.alias("start"), cutoff.alias("cutoff"))


_SEARCH = f"""WITH {v.ARTICLES}, q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    strftime(DATE '2024-01-05' + CAST(vec_id % 40 AS INTEGER), '%Y-%m-%d') AS start, strftime(DATE '2024-01-25' + CAST(vec_id % 60 AS INTEGER), '%Y-%m-%d') AS cutoff FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT query_id, article_id, published_date, start, cutoff, round(list_inner_product(e, list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_inner_product(e, e)), 6) AS score FROM q, articles)"""
_TOP = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS INTEGER) AS rank, article_id, round(score, {digits}) AS score FROM {rows} QUALIFY rank <= {k}"


def _hits(hits: DataFrame, digits: int = 6) -> DataFrame:
    return hits.select("query_id", "rank", "article_id", F.round("score", digits).alias("score"))


@query(f"{_SEARCH} {_TOP.format(rows='s', k=5, digits=6)}")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(retrieval.search(v.articles(spark, sf_dir), _query_vectors(spark, sf_dir, False), k=5))


@query(f"{_SEARCH}, w AS (SELECT * FROM s WHERE published_date BETWEEN start AND cutoff) {_TOP.format(rows='w', k=5, digits=6)}")
def vector_topk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(retrieval.search(v.articles(spark, sf_dir), _query_vectors(spark, sf_dir, True), k=5))


@query(f"{_SEARCH}, w AS (SELECT * FROM s WHERE published_date BETWEEN start AND cutoff) {_TOP.format(rows='w', k=5, digits=6)}")
def vector_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a range join of two tables, with more queries than a block holds."""
    return _hits(window_join.window_join(v.articles(spark, sf_dir), _query_vectors(spark, sf_dir, True), k=5, block=4))


@query(f"{_SEARCH} {_TOP.format(rows='s', k=5, digits=6)}")
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hits by an index of cells that is written, opened and read in part."""
    path = scratch(spark)
    vector_index.build(v.articles(spark, sf_dir), path, cells=64)
    return _hits(vector_index.search(spark, path, _query_vectors(spark, sf_dir, False), k=5)[0])


@query(f"""{_SEARCH.replace(", 6) AS score FROM q", ", 9) AS score FROM q")}, pool AS (SELECT * FROM s WHERE published_date BETWEEN start AND cutoff QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) <= 20),
  b AS (SELECT query_id, article_id, round(0.7 * score + 0.3 * (1.0 - least(greatest(date_diff('day', published_date::DATE, cutoff::DATE), 0) / 180.0, 1.0)), 9) AS score FROM pool) {_TOP.format(rows='b', k=5, digits=6)}""")
def vector_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, asked = v.articles(spark, sf_dir), _query_vectors(spark, sf_dir, True)
    pool = retrieval.search(articles, asked, k=20).drop("rank")
    dated = pool.join(articles.select("article_id", "published_date"), "article_id").join(asked.select("query_id", "cutoff"), "query_id")
    return _hits(retrieval.rerank(dated, 5, 0.7, 180.0))


@query(f"WITH {v.ARTICLES} SELECT shard, count(*) AS n FROM articles WHERE shard BETWEEN '2024-01' AND '2024-02' GROUP BY 1")
def shard_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.articles(spark, sf_dir).filter(retrieval.prune_shards("shard", "2024-01-15", "2024-02-10"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"))


@query(f"""WITH {v.ARTICLES}, r AS (SELECT article_id % 7 AS task_id, article_id, published_date, article_id % 3 AS how FROM articles)
SELECT task_id, printf('%08x-0000-0000-0000-000000000000', article_id) AS article_id, CASE WHEN how = 2 THEN 'unknown_id' WHEN published_date > '2024-02-10' OR published_date < '2024-01-10' THEN 'out_of_window' ELSE 'ok' END AS status FROM r
UNION ALL SELECT -1, printf('%08x-0000-0000-0000-000000000000', article_id), 'nothing_seen' FROM r WHERE task_id = 0 UNION ALL SELECT task_id, '', 'empty_id' FROM r WHERE task_id = 1""")
def serve_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = v.articles(spark, sf_dir).withColumn("id", F.col("article_id")).withColumn("article_id", F.concat(F.lit("<urn:uuid:"), F.lpad(F.hex("id"), 8, "0"), F.lit("-0000-0000-0000-000000000000>")))
    task = (F.col("id") % 7).alias("task_id")
    seen = articles.filter("id % 3 != 2").select(task, "article_id")
    asked = articles.select(task, F.concat(F.lit(" id="), "article_id", F.lit(", ")).alias("requested"), F.lit("2024-01-10").alias("start"), F.lit("2024-02-10").alias("cutoff"))
    # A task that has searched nothing, and requests whose id is empty once its wrapping is off.
    asked = asked.unionAll(asked.filter("task_id = 0").withColumn("task_id", F.lit(-1).cast("long"))).unionAll(asked.filter("task_id = 1").withColumn("requested", F.lit(" id=<>, ")))
    served = retrieval.serve(asked, seen, articles.drop("id"))
    return served.select("task_id", F.lower(F.regexp_replace("article_id", "^<urn:uuid:|>$", "")).alias("article_id"), "status")


@query("""WITH b AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT *, substr(t, 1, 280) AS s FROM b),
  r AS (SELECT *, 280 - instr(reverse(rpad(s, 280, ' ')), ' .') - 1 AS d, 280 - instr(reverse(rpad(s, 280, ' ')), ' !') - 1 AS e, 280 - instr(reverse(rpad(s, 280, ' ')), ' ?') - 1 AS q FROM c)
SELECT doc_id, CASE WHEN length(t) <= 280 THEN t WHEN contains(s, '. ') AND d >= 140 THEN substr(s, 1, d + 1) WHEN contains(s, '! ') AND e >= 140 THEN substr(s, 1, e + 1)
  WHEN contains(s, '? ') AND q >= 140 THEN substr(s, 1, q + 1) ELSE rtrim(s) || '…' END AS snippet FROM r""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.lit(""), "text").alias("snippet"))


@query("""SELECT page_id, CASE page_id % 2 WHEN 0 THEN printf('%08x-0000-4000-8000-00000000abcd', page_id) ELSE lower(url) END AS canonical FROM pages""")
def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    urn = F.concat(F.lit(' "id=<urn:uuid:'), F.lpad(F.hex("page_id"), 8, "0"), F.lit('-0000-4000-8000-00000000ABCD>,"'))
    raw = F.when(F.col("page_id") % 2 == 0, urn).otherwise(F.concat(F.lit("id=<"), "url", F.lit("> ")))
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_id(raw).alias("canonical"))


def _dated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.daily_belief(spark, sf_dir).select("event_id", F.col("day").alias("forecast_date"), "pos")


def _draw_sql(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || ({key})::VARCHAR), 1, 15))::BIGINT"


_SEED = 20260918
_SAMPLE = f"""WITH {v.DAILY_BELIEF}, e AS (SELECT event_id, row_number() OVER (ORDER BY {_draw_sql("event_id", _SEED)}, event_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT event_id FROM daily_belief)),
  g AS (SELECT event_id, CASE WHEN 3 * k < n THEN 'early' WHEN 3 * k < 2 * n THEN 'middle' ELSE 'late' END AS grp FROM e),
  r AS (SELECT event_id, day AS forecast_date, pos + 1 AS t, count(*) OVER (PARTITION BY event_id) AS T_Q, CASE WHEN count(*) OVER (PARTITION BY event_id) > 1 THEN pos::DOUBLE / (count(*) OVER (PARTITION BY event_id) - 1) ELSE 0.0 END AS r FROM daily_belief),
  b AS (SELECT *, CASE grp WHEN 'early' THEN r < 1.0::DOUBLE / 3 WHEN 'middle' THEN r >= 1.0::DOUBLE / 3 AND r < 2.0::DOUBLE / 3 ELSE r >= 2.0::DOUBLE / 3 END AS inside,
    round(abs(r - CASE grp WHEN 'early' THEN 1.0::DOUBLE / 6 WHEN 'middle' THEN 0.5 ELSE 5.0::DOUBLE / 6 END), 9) AS far FROM r JOIN g USING (event_id)),
  chosen AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY inside DESC, CASE WHEN inside THEN {_draw_sql("event_id * 1009 + t", _SEED + 1)} ELSE 0 END, far, t) = 1)"""


@query(f"{_SAMPLE} SELECT event_id, forecast_date, CAST(t AS INTEGER) AS t, T_Q, round(r, 6) AS r, grp AS \"group\", NOT inside AS fallback FROM chosen")
def single_date_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.single_date(_dated_rows(spark, sf_dir), _SEED).select("event_id", "forecast_date", "t", "T_Q", F.round("r", 6).alias("r"), "group", "fallback")


@query(f"""{_SAMPLE}, c AS (SELECT *, round(r, 4) AS q FROM chosen)
SELECT 'group_counts' AS stat, grp AS key, count(*)::DOUBLE AS value FROM c GROUP BY 2 UNION ALL SELECT 'r_mean_by_group', grp, round(avg(q), 4) FROM c GROUP BY 2
UNION ALL SELECT 'r_mean', '', round(avg(q), 4) FROM c UNION ALL SELECT 'r_hist_10bins', CAST(least(CAST(floor(q * 10) AS BIGINT), 9) AS VARCHAR), count(*)::DOUBLE FROM c GROUP BY 2
UNION ALL SELECT 't_hist', CAST(t AS VARCHAR), count(*)::DOUBLE FROM c GROUP BY 2 UNION ALL SELECT 'T_Q_hist', CAST(T_Q AS VARCHAR), count(*)::DOUBLE FROM c GROUP BY 2
UNION ALL SELECT 'kind_out', CASE event_id % 3 WHEN 0 THEN 'multi' ELSE 'binary' END, count(*)::DOUBLE FROM c GROUP BY 2 UNION ALL SELECT 'kind_in', CASE event_id % 3 WHEN 0 THEN 'multi' ELSE 'binary' END, count(*)::DOUBLE FROM daily_belief GROUP BY 2
UNION ALL SELECT 'rows_out', '', count(*)::DOUBLE FROM c UNION ALL SELECT 'fallbacks', '', count(*) FILTER (NOT inside)::DOUBLE FROM c
UNION ALL SELECT 'rows_in', '', count(*)::DOUBLE FROM daily_belief UNION ALL SELECT 'events', '', count(DISTINCT event_id)::DOUBLE FROM daily_belief""")
def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dated_rows(spark, sf_dir).withColumn("belief_kind", F.when(F.col("event_id") % 3 == 0, "multi").otherwise("binary"))
    return sampling.statistics(sampling.single_date(rows, _SEED), rows)


@query("""SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 6""")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_labels(table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("event_id").alias("input_pos")))


@query("""WITH e AS (SELECT event_id, event_type FROM events), c AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'n_exhausted' ELSE 'n_failed_attempts' END AS counter FROM e WHERE event_type IN ('error', 'view')
  UNION ALL SELECT 'by_type/' || CASE event_type WHEN 'error' THEN 'ReadTimeout' ELSE 'ConnectError' END FROM e WHERE event_type IN ('error', 'view'))
SELECT counter, count(*) AS n FROM c GROUP BY 1""")
def retry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "ReadTimeout").otherwise("ConnectError")
    said = F.when(F.col("event_id") % 3 == 0, " after 3 attempts").otherwise(" on attempt 1")
    line = F.when(F.col("event_type").isin("error", "view"), F.concat(F.lit("request failed"), said, F.lit(": "), kind, F.lit(": "), "props")).otherwise(F.lit("request served"))
    return traces.retry_counts(e.select(line.alias("message")))


@query("""SELECT event_type AS name, CAST(sum(CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)) AS BIGINT) AS n FROM events GROUP BY 1""")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("n"))
    return metrics.merge_counters(metrics.merge_counters(e.filter("n % 2 = 0")).unionAll(metrics.merge_counters(e.filter("n % 2 = 1"))))


@query("""SELECT user_id AS event_id, event_id AS step, lag(event_type) OVER w AS prev_notebook FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def notebook_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.col("event_id").alias("step_idx"), F.col("event_type").alias("notebook"))
    return episodes.carried_notebook(e).select("event_id", F.col("step_idx").alias("step"), "prev_notebook")


@query("""SELECT user_id AS event_id, event_id AS step_idx FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM events) WHERE f = 0""")
def stop_at_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.col("event_id").alias("step_idx"), (F.col("event_type") == "error").alias("failed"))
    return episodes.until_failure(e).select("event_id", "step_idx")


@query("""SELECT c_custkey AS id, 'Question: ' || c_name || chr(10) || 'Resolves: 2024-02-01' || chr(10) || 'Outcomes: YES / NO. Forecast a probability for each label; the two probabilities must sum to 1.'
  || chr(10) || chr(10) || 'Resolution criteria / context:' || chr(10) || c_mktsegment || chr(10) || chr(10) || 'Forecast date: 2024-01-05' || chr(10) || chr(10) || 'Belief Notebook: None' AS prompt FROM customer""")
def step_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = F.array().cast("array<struct<label:string,question:string>>")
    q = F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"), F.lit("2024-02-01").alias("close_date"), F.lit("binary").alias("belief_kind"), market.alias("markets"))
    rows = table(spark, sf_dir, "customer").withColumn("q", q)
    return rows.select(F.col("c_custkey").alias("id"), rendering.step_prompt(rendering.question_text(F.col("q")), F.lit("2024-01-05"), F.lit(None).cast("string")).alias("prompt"))


@query("""SELECT event_type AS kind, CASE event_type WHEN 'view' THEN 'task_complete' WHEN 'click' THEN 'max_tokens_reached' WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'connection_error' ELSE 'unclassified_error' END AS termination, count(*) AS n FROM events GROUP BY 1, 2""")
def termination_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = {"click": ("EventLoopException", "EventLoopException", "MaxTokensReachedException"), "error": ("EventLoopException", "ValueError", "ReadTimeoutError"), "signup": ("ServerDisconnectedError",), "purchase": ("KeyError",)}
    names = F.lit(None).cast("array<string>")
    for kind, errors in chain.items():
        names = F.when(F.col("event_type") == kind, F.array(*[F.lit(e) for e in errors])).otherwise(names)
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), text.termination(names).alias("termination"))
    return rows.groupBy("kind", "termination").agg(F.count("*").alias("n"))


_SNIP = """b AS (SELECT article_id, text, title, published_date, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM articles), c AS (SELECT *, substr(t, 1, 280) AS s FROM b),
  r AS (SELECT *, 280 - instr(reverse(rpad(s, 280, ' ')), ' .') - 1 AS d, 280 - instr(reverse(rpad(s, 280, ' ')), ' !') - 1 AS e, 280 - instr(reverse(rpad(s, 280, ' ')), ' ?') - 1 AS q FROM c),
  n AS (SELECT *, CASE WHEN length(t) <= 280 THEN t WHEN contains(s, '. ') AND d >= 140 THEN substr(s, 1, d + 1) WHEN contains(s, '! ') AND e >= 140 THEN substr(s, 1, e + 1)
    WHEN contains(s, '? ') AND q >= 140 THEN substr(s, 1, q + 1) ELSE rtrim(s) || '…' END AS snippet FROM r)"""


@query(f"""{_SEARCH}, w AS (SELECT * FROM s WHERE published_date BETWEEN start AND cutoff), h AS ({_TOP.format(rows="w", k=5, digits=6)}), {_SNIP}
SELECT query_id, string_agg('[' || rank || '] ' || title || chr(10) || 'url: https://example.org/' || article_id || chr(10) || 'id: ' || article_id || chr(10) || 'published: ' || published_date
  || chr(10) || 'score: ' || printf('%.4f', score) || chr(10) || snippet, chr(10) || chr(10) ORDER BY rank) AS results FROM h JOIN n USING (article_id) GROUP BY 1
UNION ALL SELECT -1 - vec_id, 'No results found.' FROM embeddings WHERE vec_id % 50 = 0""")
def search_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as text; each query asks once more for a year that no article is from."""
    articles, asked = v.articles(spark, sf_dir), _query_vectors(spark, sf_dir, True)
    late = asked.withColumns({"query_id": -1 - F.col("query_id"), "start": F.lit("2031-01-01"), "cutoff": F.lit("2031-12-31")})
    asked = asked.unionByName(late)
    hits = retrieval.search(articles, asked, k=5, digits=6)
    return retrieval.render_hits(hits, articles, asked)


@query(f"""WITH {v.ARTICLES}, w AS (SELECT article_id, text, title, published_date, regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+') AS t FROM articles)
SELECT article_id, 'id: ' || article_id || chr(10) || 'title: ' || title || chr(10) || 'url: https://example.org/' || article_id || chr(10) || 'published: ' || published_date || chr(10) || chr(10)
  || CASE WHEN article_id % 2 = 0 THEN 'kept ' || article_id WHEN len(t) > 40 THEN array_to_string(t[1:40], ' ') || '...' ELSE text END AS article FROM w""")
def article_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 40 words, or the stored truncation of every other article."""
    cached = F.when(F.col("article_id") % 2 == 0, F.concat(F.lit("kept "), "article_id"))
    return retrieval.render_articles(v.articles(spark, sf_dir).withColumn("cached", cached), budget=40)
