"""Queries that go through files and streams, and over small projections.

Rows of the driver's tables are written by the sinks to a scratch folder and read back by
the readers under test; the SQL says what must come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rewards, text
from ..operators import dates, episodes, evaluation, metrics
from ..sources import config, files, loader, positions, shards, sinks
from ..sources.scratch import scratch, staged
from ..streaming import runs, state
from . import views as v
from .registry import query
from .views import table


def _lines(spark: SparkSession, rows: DataFrame, name: str = "lines") -> str:
    """``rows`` as JSON lines."""
    path = f"{scratch(spark)}/{name}"
    sinks.episodes(rows, path)
    return path


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as prepared questions: days and news of every fifth differ in number."""
    day = lambda i: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 50 + i).cast("int")), "yyyy-MM-dd")
    days = F.array(*[F.concat(day(i), F.lit("T00:00:00Z")) for i in range(3)])
    news = F.array(*[(F.col("c_custkey") % 7 + i).cast("long") for i in range(3)])
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("event_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body"), day(60).alias("close_date"),
        F.lit("binary").alias("belief_kind"), F.array("c_mktsegment", F.lit("new")).alias("tags"), days.alias("daily_index"),
        F.when(F.col("c_custkey") % 5 == 0, F.slice(news, 1, 2)).when(F.col("c_custkey") % 5 != 1, news).alias("news_daily"),
    )


@query("SELECT c_custkey::VARCHAR AS event_id, c_name AS title, c_mktsegment || ',new' AS tags, strftime(DATE '2024-03-01' + CAST(c_custkey % 50 AS INTEGER), '%Y-%m-%d') AS close_date FROM customer")
def question_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as JSON lines and read strictly."""
    read = files.questions(spark, _lines(spark, _customers(spark, sf_dir)))
    return read.select("event_id", "title", F.array_join("tags", ",").alias("tags"), "close_date")


@query("""SELECT c_custkey::VARCHAR AS event_id, CAST(i AS INTEGER) AS pos, strftime(DATE '2024-01-01' + CAST(c_custkey % 50 + i AS INTEGER), '%Y-%m-%d') AS day,
  CASE WHEN c_custkey % 5 IN (0, 1) THEN 0.0 ELSE CAST(c_custkey % 7 + i AS DOUBLE) END AS news FROM customer, range(3) r(i)""")
def question_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with news of the questions read back; a series that is missing or of another length counts as zeros."""
    return dates.question_days(files.questions(spark, _lines(spark, _customers(spark, sf_dir))))


@query("""SELECT c_custkey::VARCHAR AS event_id, CASE WHEN c_custkey % 2 = 0 THEN strftime(DATE '2024-02-01' + CAST(c_custkey % 20 AS INTEGER), '%Y-%m-%d') WHEN c_custkey % 3 = 0 THEN '2024-05-09'
  WHEN c_custkey % 5 = 0 THEN '2024-06-07' END AS resolves FROM customer""")
def resolution_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close date, else the latest leg, else resolution and end date; what doesn't parse is passed over."""
    key = F.col("c_custkey")
    close = F.when(key % 2 == 0, F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (key % 20).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("2024-99-01"))
    legs = F.when(key % 3 == 0, F.array(F.lit("2024-05-01"), F.lit("soon"), F.lit("2024-05-09T10:00:00Z")))
    resolves = dates.resolution_date(close, legs, F.when(key % 5 == 0, F.lit("2024-06-07")), F.lit("never"))
    return table(spark, sf_dir, "customer").select(key.cast("string").alias("event_id"), F.date_format(resolves, "yyyy-MM-dd").alias("resolves"))


@query("""SELECT event_id, strftime(DATE '2024-01-01' + CAST(i AS INTEGER), '%Y-%m-%d') AS forecast_date, CASE WHEN i < 2 THEN round(0.1::DOUBLE * (i + 1), 6) END AS crowd_prob, CAST(i AS INTEGER) AS step_idx
FROM (SELECT c_custkey::VARCHAR AS event_id, row_number() OVER (ORDER BY c_name DESC, c_custkey) - 1 AS position FROM customer), range(3) r(i) WHERE position BETWEEN 10 AND 59""")
def prepared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared episodes read strictly, cut to lines 10 to 59, decoded and taken apart; the third probability is missing."""
    meta = F.struct(F.array(*[F.lit(f"2024-01-0{i}") for i in (1, 2, 3)]).alias("forecast_dates"), F.array(F.lit(0.1), F.lit(0.2)).alias("crowd_probs"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("event_id"), F.col("c_name").alias("prompt"), meta.alias("metadata"))
    lines = positions.numbered_lines(spark, _lines(spark, rows.orderBy(F.col("prompt").desc(), F.col("event_id").cast("long"))))
    read = files.strict_rows(lines, files.EPISODE)
    read = read.select("event_id", "metadata.forecast_dates", "metadata.crowd_probs", F.col("position").alias("input_pos"))
    return episodes.steps(episodes.decode(episodes.check_mode(read, "memory-on"), 10, 60)).select("event_id", "forecast_date", "step_idx", F.round("crowd_prob", 6).alias("crowd_prob"))


def _result_lines(spark: SparkSession, sf_dir: str) -> str:
    """Result records as text; of ten lines one goes on after its object, one is cut, one is blank and one has single quotes."""
    e = table(spark, sf_dir, "events")
    error = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("string")).otherwise("event_type")
    record = F.struct(F.col("user_id").cast("string").alias("event_id"), F.col("event_id").alias("rollout_idx"), F.round(F.col("value") / 1000, 6).alias("brier"))
    whole = F.when(F.col("event_id") % 2 == 0, F.to_json(record)).otherwise(F.concat(F.regexp_replace(F.to_json(record), r"\}$", ""), F.lit(',"error":'), F.coalesce(F.concat(F.lit('"'), error, F.lit('"')), F.lit("null")), F.lit("}")))
    kind = F.col("event_id") % 10
    line = F.when(kind == 1, F.concat(whole, F.lit(" junk"))).when(kind == 3, F.substring(whole, 1, 12)).when(kind == 5, F.lit(" ")).when(kind == 7, F.translate(whole, '"', "'")).otherwise(whole)
    path = f"{scratch(spark)}/results"
    e.select(line.alias("value")).write.text(path)
    return path


_RESULTS = "SELECT user_id::VARCHAR AS event_id, event_id AS rollout_idx, round(value / 1000, 6) AS brier, event_id % 2 = 1 AS has_error FROM events WHERE event_id % 10 NOT IN (1, 3, 5, 7)"


@query(f"SELECT event_id, CAST(rollout_idx AS INTEGER) AS rollout_idx, brier, has_error FROM ({_RESULTS})")
def result_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines read leniently: malformed ones go, an error key counts even with a null in it."""
    return files.results(spark, _result_lines(spark, sf_dir)).select("event_id", "rollout_idx", "brier", "has_error")


@query(f"""SELECT user_id::VARCHAR AS event_id, count(*) AS n_left FROM events WHERE (user_id::VARCHAR, event_id) NOT IN (SELECT event_id, rollout_idx FROM ({_RESULTS})) GROUP BY 1""")
def resume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units without a record in an earlier run's files: those of malformed lines are to be done again."""
    units = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("event_id"), F.col("event_id").cast("int").alias("rollout_idx"))
    left = evaluation.remaining(units, files.completed(spark, _result_lines(spark, sf_dir)))
    return left.groupBy("event_id").agg(F.count("*").alias("n_left"))


def _article_files(spark: SparkSession, sf_dir: str) -> str:
    path = f"{scratch(spark)}/articles"
    v.articles(spark, sf_dir).select("article_id", "published_date", "title", "text", "shard").write.partitionBy("shard").parquet(path)
    return path


def _cut_article_files(spark: SparkSession, sf_dir: str) -> str:
    """As above, but only January and February have stored truncations."""
    path = f"{scratch(spark)}/articles"
    rows = v.articles(spark, sf_dir).select("article_id", "published_date", "title", "text", "shard")
    rows.filter("shard <= '2024-02'").withColumn("text_truncated", F.concat(F.lit("cut "), "article_id")).write.partitionBy("shard").parquet(path)
    rows.filter("shard > '2024-02'").write.mode("append").partitionBy("shard").parquet(path)
    return path


@query(f"WITH {v.ARTICLES} SELECT published_date, count(*) AS n FROM articles GROUP BY 1")
def published_dates_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.published_dates(spark, _article_files(spark, sf_dir)).groupBy("published_date").agg(F.count("*").alias("n"))


@query(f"WITH {v.ARTICLES} SELECT article_id, shard, title, NULL::VARCHAR AS summary, CASE WHEN shard = '2024-02' THEN 'cut ' || article_id END AS cached FROM articles")
def article_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of all shards with their metadata: only February's were cut for this tokenizer and budget."""
    read = shards.read_shards(spark, _cut_article_files(spark, sf_dir))
    folder = f"{scratch(spark)}/metadata"
    for shard, made in (("2024-01", {"tokenizer": "other", "token_budget": 8000}), ("2024-02", {"tokenizer": "words", "token_budget": 8000})):
        line = F.to_json(F.struct(F.struct(F.lit(made["tokenizer"]).alias("tokenizer"), F.lit(made["token_budget"]).alias("token_budget")).alias("scrape_truncation")))
        spark.range(1).select(line.alias("value")).write.text(f"{folder}/shard={shard}")
    metadata = files.shard_metadata(spark, f"{folder}/*/*.txt")
    return files.served_text(read, metadata, "words", 8000).select("article_id", "shard", "title", "summary", "cached")


#: Events of one volume object.
_KEYS = 100_000


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS n FROM events GROUP BY 1")
def volume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume objects with a key for each event, one in a file of ``_KEYS`` events at most: keys are cut to the day, the last of a day wins."""
    e = table(spark, sf_dir, "events")
    pair = F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("#"), F.col("event_id"), F.lit('":'), F.col("event_id"))
    rows = e.select("event_id", pair.alias("pair"), F.format_string("%015d", F.floor(F.col("event_id") / _KEYS)).alias("object")).filter("pair is not null")
    order = Window.partitionBy("object").orderBy("event_id")
    head, tail = F.when(F.row_number().over(order) == 1, "{").otherwise(""), F.when(F.lead("event_id").over(order).isNull(), "}").otherwise(",")
    path = f"{scratch(spark)}/volume"
    rows = rows.select("object", "event_id", F.concat(head, "pair", tail).alias("value")).sortWithinPartitions("object", "event_id")
    rows.select("object", "value").write.partitionBy("object").text(path)
    return files.volume_json(spark, path)


@query("SELECT 'rollouts' AS key, '8' AS value UNION ALL SELECT 'metric', 'log_prob' UNION ALL SELECT 'mode', 'memory-on' UNION ALL SELECT 'prompt', 'shared.md' UNION ALL SELECT 'rows', count(*)::VARCHAR FROM customer WHERE c_custkey >= 10")
def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with an override, the prompt that is found first, and the rows that the start leaves."""
    c = config.RunConfig.from_dict({"mode": "memory-on", "rollouts": 4, "metric": "log_prob", "question_start": 10}, rollouts=8, metric=None)
    rows = episodes.decode(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("input_pos"), F.array().alias("crowd_probs")), c.question_start)
    known = {"rollouts": str(c.rollouts), "metric": c.metric, "mode": c.mode, "prompt": config.prompt_source(None, "", "shared.md")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(x).alias("value")) for k, x in known.items()]))
    return spark.range(1).select(pairs.alias("p")).select("p.*").unionAll(rows.agg(F.count("*")).select(F.lit("rows"), F.col("count(1)").cast("string")))


@query("""SELECT 'sample' AS part, count(*) AS n, sum(c_custkey) AS ids FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'selection', count(*), sum(c_custkey) FROM customer
UNION ALL SELECT 'stats', 1, max(c_custkey) FROM customer UNION ALL SELECT 'appended', 2 * count(*), 2 * sum(c_custkey) FROM customer UNION ALL SELECT 'metrics', 2, 2 * max(c_custkey) + 3 FROM customer""")
def sinks_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, selection and statistics side by side; records appended twice; a metric table of two steps."""
    folder = scratch(spark)
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    top = ids.agg(F.max("id").alias("id"))
    sinks.sample(ids.filter("id % 2 = 0"), ids, top, folder)
    for step in (1, 2):
        sinks.append_records(ids, f"{folder}/appended")
        sinks.metric_table(top, f"{folder}/metrics", step)
    count = lambda part, rows, value="id": rows.agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.sum(value).cast("long").alias("ids"))
    read = lambda name: spark.read.schema("id long").json(f"{folder}/{name}")
    out = count("sample", read("sample")).unionAll(count("selection", read("selection"))).unionAll(count("stats", read("build_stats")))
    return out.unionAll(count("appended", read("appended"))).unionAll(count("metrics", spark.read.parquet(f"{folder}/metrics").withColumn("v", F.col("id") + F.col("step")), "v"))


@query("SELECT 'a run' AS model, 3 AS rollouts, 'Forecast ' || count(*) AS prompt FROM customer")
def manifest_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.manifest(spark, {"model": "a run", "rollouts": 3}, {"main": f"Forecast {table(spark, sf_dir, 'customer').count()}"}, path)
    read = files.strict_json(spark, path, "config STRUCT<model: STRING, rollouts: INT>, prompts STRUCT<main: STRING>")
    return read.select("config.model", "config.rollouts", F.col("prompts.main").alias("prompt"))


_CARD = """SELECT l_returnflag AS run_id, count(*) AS n_rows, count(*) FILTER (l_linenumber % 2 = 0) AS n_scored, 0 AS n_errors, avg(l_discount) FILTER (l_linenumber % 2 = 0) AS brier,
  avg(l_tax) FILTER (l_linenumber % 2 = 0) AS log_loss, 0.5 AS accuracy FROM lineitem GROUP BY 1"""


def _card_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run_id"), F.col("l_discount").alias("brier"), (-F.col("l_tax")).alias("log_prob"), F.lit(0.5).alias("accuracy"),
        F.lit(None).cast("double").alias("info_alpha"), F.lit(False).alias("has_error"), (F.col("l_linenumber") % 2 == 0).alias("parse_ok"),
    )


@query(f"""SELECT run_id, '── all ──' || chr(10) || '  n_rows       ' || n_rows || chr(10) || '  n_scored     ' || n_scored || chr(10) || '  n_errors     0' || chr(10) || '  brier        ' || printf('%.4f', brier)
  || chr(10) || '  log_loss     ' || printf('%.4f', log_loss) || chr(10) || '  accuracy     0.5000' || chr(10) || '  info_alpha   None' AS card FROM ({_CARD})""")
def scorecard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = evaluation.scorecard(_card_records(spark, sf_dir), ("run_id",))
    return evaluation.card_text(card, "all", "run_id")


@query(f"SELECT run_id, n_rows, n_scored, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM ({_CARD})")
def stream_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that arrive as files, scored as a stream to the same card."""
    folder, name = scratch(spark), f"card_{scratch(spark)[-8:]}"
    sinks.append_records(_card_records(spark, sf_dir).drop("info_alpha").repartition(3), f"{folder}/in")
    kind = "run_id STRING, brier DOUBLE, log_prob DOUBLE, accuracy DOUBLE, info_alpha DOUBLE, has_error BOOLEAN, parse_ok BOOLEAN"
    started = runs.running_scorecard(runs.record_stream(spark, f"{folder}/in", kind, 1), name, f"{folder}/checkpoint")
    started.processAllAvailable()
    started.stop()
    return spark.table(name).select("run_id", "n_rows", "n_scored", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@query("SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters drained batch by batch, one file at a time, then merged."""
    folder = scratch(spark)
    table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit(1).cast("long").alias("n")).repartition(3).write.parquet(f"{folder}/in")
    parts = spark.readStream.schema("name string, n long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    runs.drain_counters(parts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return metrics.merge_counters(spark.read.parquet(f"{folder}/out").select("name", "n"))


_STEPS = f"""WITH {v.ARTICLES}, q AS (SELECT vec_id * 10 + i AS query_id, embedding AS e, '2024-01-05' AS start, strftime(DATE '2024-01-15' + CAST(20 * i AS INTEGER), '%Y-%m-%d') AS cutoff FROM embeddings, range(3) r(i) WHERE vec_id % 50 = 0),
  s AS (SELECT query_id, article_id, round(list_inner_product(list_transform(e, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_inner_product(list_transform(e, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE))), 6) AS score
    FROM q, articles WHERE published_date BETWEEN start AND cutoff)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS INTEGER) AS rank, article_id FROM s QUALIFY rank <= 3"""


@query(_STEPS)
def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that arrive as a stream: each sees the articles up to its own date, 20 days more than the step before."""
    folder = scratch(spark)
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select("vec_id", F.col("embedding").alias("vector"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    cutoff = F.date_format(F.date_add(F.lit("2024-01-15").cast("date"), 20 * F.col("i")), "yyyy-MM-dd")
    asked = e.select((F.col("vec_id") * 10 + F.col("i")).alias("query_id"), "vector", F.lit("2024-01-05").alias("start"), cutoff.alias("cutoff"))
    asked.repartition(2).write.parquet(f"{folder}/in")
    steps = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    runs.stepwise_search(steps, v.articles(spark, sf_dir), f"{folder}/out", f"{folder}/checkpoint", k=3).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("query_id", "rank", "article_id")


_NOTES = "SELECT user_id AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step_idx, CASE WHEN event_id % 3 > 0 THEN event_type END AS notebook FROM events"


@query(f"SELECT event_id, step_idx, notebook, lag(notebook) OVER (PARTITION BY event_id ORDER BY step_idx) AS prev_notebook FROM ({_NOTES})")
def stream_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks carried by a stream: steps arrive out of order, and the query is stopped half-way and started again."""
    folder = scratch(spark)
    e = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = e.select(F.col("user_id").alias("event_id"), step.cast("long").alias("step_idx"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("notebook"))
    rows = staged(rows.withColumn("part", F.pmod(F.xxhash64("event_id", "step_idx"), F.lit(2))))
    for part in (0, 1):
        rows.filter(F.col("part") == part).drop("part").coalesce(2).write.mode("append").parquet(f"{folder}/in")
        steps = spark.readStream.schema("event_id long, step_idx long, notebook string").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        state.carried_notebook(steps, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "step_idx", "notebook", "prev_notebook")


@query(f"""SELECT user_id::VARCHAR AS event_id, event_id AS rollout_idx, 1 AS n FROM events WHERE (user_id::VARCHAR, event_id) NOT IN (SELECT event_id, rollout_idx FROM ({_RESULTS}))""")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stopped and restarted stream of units logs, beside an earlier run's records: each unit once, although all of them arrive twice."""
    folder, done = scratch(spark), files.completed(spark, _result_lines(spark, sf_dir))
    units = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("event_id"), F.col("event_id").cast("int").alias("rollout_idx"))
    for part in (units.filter("rollout_idx % 2 = 0"), units):
        part.repartition(2).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema("event_id string, rollout_idx int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        state.evaluation_log(arriving, done, lambda rows: rows, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = spark.read.schema("event_id string, rollout_idx int").json(f"{folder}/log")
    return log.groupBy("event_id", "rollout_idx").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 2 = 0 THEN 'm' END AS model_name, value AS brier, NULL AS reward, 'search' AS prompt_source FROM events""")
def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the fixed column order; what a run lacks is null."""
    rows = table(spark, sf_dir, "events").select(
        F.col("value").alias("brier"), F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 2 == 0, "m").alias("model_name"), F.lit("search").alias("prompt_source"), "ts",
    )
    out = evaluation.records(rows)
    if tuple(out.columns) != evaluation.RECORD:
        raise ValueError("the columns are not those of a record")
    return out.select("event_id", "model_name", "brier", F.col("reward").cast("string").alias("reward"), "prompt_source")


@query("""SELECT user_id AS group_index, event_id AS rollout_id, CASE event_type WHEN 'view' THEN 'COMPLETED' ELSE 'TRUNCATED' END AS status, event_id % 5 AS step_idx FROM events""")
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = F.when(F.col("event_type") == "view", "task_complete").otherwise("timeout")
    steps = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("group_index"), F.col("event_id").alias("rollout_id"), F.col("value").alias("reward"), ended.alias("termination"), (F.col("event_id") % 5).alias("step_idx"), F.lit("2024-01-01").alias("forecast_date"),
    )
    return evaluation.sample_rows(steps).select("group_index", "rollout_id", "status", "metadata.step_idx")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'base' END AS spec FROM customer")
def spec_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override counts where it is given and differs from the default."""
    override = F.when(F.col("c_custkey") % 3 == 0, "own").when(F.col("c_custkey") % 3 == 1, "standard")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), episodes.merged_spec(F.lit("standard"), override, F.lit("base")).alias("spec"))


@query("""WITH g AS (SELECT CASE WHEN user_id % 4 > 0 THEN user_id END AS question, event_type, event_id % 3 AS step FROM events)
SELECT question, step, CASE WHEN question IS NULL THEN 0 ELSE 1 END AS n_groups, count(*) AS n FROM g GROUP BY 1, 2""")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group id for each question and step, the same in all its rows; none without a question."""
    question = F.when(F.col("user_id") % 4 > 0, F.struct(F.col("user_id").alias("title"), F.lit(None).alias("none")))
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("question"), (F.col("event_id") % 3).alias("step"), episodes.question_group(question).alias("base"))
    rows = rows.withColumn("group", episodes.step_group(F.col("base"), F.col("step"), 1000))
    whole = rows.groupBy("group").agg(F.count_distinct("question", "step").alias("members")).filter("group is not null and members <> 1")
    if not whole.isEmpty():
        raise ValueError("one group id stands for two groups")
    return rows.groupBy("question", "step").agg(F.count_distinct("group").cast("int").alias("n_groups"), F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-03-05' WHEN 1 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, " 2024/3/5 noon").when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).when(F.col("event_id") % 4 == 2, "2024-02-30")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(text.lenient_date(raw), "yyyy-MM-dd").alias("day"))


@query("""WITH w AS (SELECT doc_id, text, regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+') AS t FROM documents)
SELECT doc_id, CASE WHEN len(t) > 25 THEN array_to_string(t[1:25], ' ') || '...' ELSE text END AS cut FROM w""")
def token_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_tokens("text", 25).alias("cut"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'memory-on' ELSE 'memory-free' END || CASE WHEN event_id % 2 = 0 THEN '-tools' ELSE '' END || '.md' AS file FROM events""")
def prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("event_id") % 3 == 0, "memory-on").otherwise("memory-free")
    return table(spark, sf_dir, "events").select("event_id", text.prompt_file(mode, F.col("event_id") % 2 == 0).alias("file"))


@query("""SELECT c_custkey AS id, round(-2 * (1 - (0.01 * (c_custkey % 100 + 1)) / (0.01 * (c_custkey % 100 + 1) + 0.5)) ** 2 + 0.5 * ((c_custkey % 4) / 4.0 - 1), 6) AS reward FROM customer""")
def tool_penalised_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reward named by its dotted path: the proper score with a penalty for unknown tools."""
    made = loader.named_class("tidemark.functions.rewards.ProperScore")
    reward: rewards.Reward = made("brier", tool_coef=0.5, tool_quality=(F.col("c_custkey") % 4) / 4.0)
    forecast = F.create_map(F.lit("YES"), 0.01 * (F.col("c_custkey") % 100 + 1), F.lit("NO"), F.lit(0.5))
    record = reward.compute(forecast, F.lit("YES"), F.lit(None).cast("double"), F.lit(1.0))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(record["reward"], 6).alias("reward"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 20")
def last_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.keep_last(table(spark, sf_dir, "events").select("event_id", "user_id"), 20, "event_id")


@query("SELECT event_id FROM events ORDER BY ('0x' || substr(md5('5|' || event_id::VARCHAR), 1, 15))::BIGINT, event_id LIMIT 20")
def rollout_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample: the same rows on any cluster."""
    return metrics.random_sample(table(spark, sf_dir, "events").select("event_id"), 20, "event_id", seed=5)
