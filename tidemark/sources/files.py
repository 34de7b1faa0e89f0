"""JSON-lines and Parquet readers with the strictness each input calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import positions
from .scratch import staged

_LEG = "STRUCT<label: STRING, question: STRING, market_id: STRING, closed_time: STRING>"
_META = "start_date: STRING, forecast_dates: ARRAY<STRING>, crowd_probs: ARRAY<DOUBLE>, forecast_date: STRING, crowd_prob: DOUBLE"
QUESTION = f"""event_id STRING, slug STRING, title STRING, body STRING, start_date STRING, close_date STRING, end_date STRING,
resolution_date STRING, belief_kind STRING, resolved_label STRING, winner_market_index INT, tags ARRAY<STRING>, markets ARRAY<{_LEG}>,
num_markets INT, daily_index ARRAY<STRING>, raw_yes_history STRING, normalized_history STRING,
daily_volume_by_market MAP<STRING, ARRAY<STRUCT<notional: DOUBLE>>>, news_daily ARRAY<BIGINT>"""
EPISODE = f"event_id STRING, slug STRING, belief_kind STRING, label STRING, prompt STRING, metadata STRUCT<{_META}>"
RESULT = """run_id STRING, model_name STRING, event_id STRING, rollout_idx INT, step_idx INT, parse_ok BOOLEAN, brier DOUBLE,
log_prob DOUBLE, accuracy DOUBLE, info_alpha DOUBLE, reward DOUBLE, error STRING"""


#: Stands behind a line in the check of it.
_STOP = "end of line 5f0d6c1e"
_STRICT = {"allowSingleQuotes": "false"}


def json_object(line: Column | str) -> Column:
    """Is the line one JSON object and nothing else?

    ``from_json`` stops where the object ends, whatever follows. As an element of a list,
    the line has to end where the list goes on.
    """
    line = F.col(line) if isinstance(line, str) else line
    listed = F.from_json(F.concat(F.lit("["), line, F.lit(f',"{_STOP}"]')), "array<string>", _STRICT)
    return F.coalesce(F.ltrim(line).startswith("{") & (F.size(listed) == 2) & (F.get(listed, 1) == _STOP), F.lit(False))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(~F.col("value").rlike(r"^\s*$"))


def strict_rows(lines: DataFrame, schema: str) -> DataFrame:
    """The objects of ``lines`` (value, beside it what is kept); fails on a malformed one, also on one that goes on after its object."""
    malformed = F.raise_error(F.concat(F.lit("malformed JSON line: "), F.substring("value", 1, 200))).cast("boolean")
    lines = lines.filter(F.when(json_object("value"), F.lit(True)).otherwise(malformed))
    kept = [c for c in lines.columns if c != "value"]
    return lines.select(*kept, F.from_json("value", schema, _STRICT | {"mode": "FAILFAST"}).alias("_r")).select(*kept, "_r.*")


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a malformed line; blank lines are skipped."""
    return strict_rows(_lines(spark, path), schema)


def valid_json(lines: DataFrame, schema: str) -> DataFrame:
    """The objects of ``lines`` (value); malformed and blank lines are dropped."""
    return lines.filter(json_object("value")).select(F.from_json("value", schema, _STRICT).alias("r")).select("r.*")


def lenient_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines are dropped."""
    return valid_json(spark.read.text(path), schema)


def unbroken_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on a malformed line and on a blank one."""
    if not spark.read.text(path).filter(F.trim("value") == "").isEmpty():
        raise ValueError(f"{path} has a blank line")
    return strict_json(spark, path, schema)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return strict_json(spark, path, QUESTION)


def history(column: str):
    """An ordered history object as array of {leg_idx, label, series}: document order is kept."""
    labels = F.json_object_keys(column)
    series = lambda k: F.from_json(F.get_json_object(F.col(column), "$"), "map<string, array<double>>")[k]
    return F.transform(labels, lambda k, i: F.struct(i.alias("leg_idx"), k.alias("label"), series(k).alias("series")))


def result_rows(lines: DataFrame) -> DataFrame:
    """Evaluation records of ``lines`` (value, beside it what is kept); has_error tells whether the error key is there, null or not."""
    lines = lines.filter(json_object("value"))
    kept = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*kept, F.from_json("value", RESULT, _STRICT).alias("_r"), F.json_object_keys("value").alias("_keys"))
    return parsed.select(*kept, "_r.*", F.array_contains("_keys", "error").alias("has_error"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records; malformed lines are dropped."""
    return result_rows(spark.read.text(path))


def completed(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, rollout_idx) of an earlier run; empty where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "event_id string, rollout_idx int")
    return results(spark, path).select("event_id", "rollout_idx")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of all shards; optional columns that no file has are null."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for c in ("published_date", "summary", "text_truncated"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def published_dates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("published_date")


def served_text(articles: DataFrame, metadata: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """Adds cached: the stored truncation where its shard was made with this tokenizer and budget."""
    fits = metadata.filter((F.col("tokenizer") == tokenizer) & (F.col("token_budget") == budget)).select("shard").distinct().withColumn("_fits", F.lit(True))
    joined = articles.join(fits, "shard", "left")
    return joined.withColumn("cached", F.when(F.col("_fits"), F.col("text_truncated"))).drop("_fits")


#: Pieces of broken entries that one task puts in order.
_STRETCH = 1 << 16


def _joined_pieces(pieces: DataFrame) -> DataFrame:
    """Entries of pieces (position, value, first, last, quotes) that commas inside of keys have broken.

    An entry has two quotes, so half the quotes before a piece is the entry's number. They
    are summed in two levels: stretches of pieces, then the list of stretches.
    """
    pieces = pieces.withColumn("stretch", F.floor(F.col("position") / _STRETCH))
    sums = pieces.groupBy("stretch").agg(F.sum("quotes").alias("held"))
    sums = sums.select("stretch", (F.sum("held").over(Window.orderBy("stretch")) - F.col("held")).alias("before"))
    within = F.sum("quotes").over(Window.partitionBy("stretch").orderBy("position")) - F.col("quotes")
    entry = F.floor((F.col("before") + F.col("within")) / 2)
    rows = pieces.withColumn("within", within).join(sums, "stretch").withColumn("entry", entry)
    held = F.array_sort(F.collect_list(F.struct("position", "value")))
    text = F.array_join(F.transform(held, lambda x: x["value"]), ",")
    return rows.groupBy("entry").agg(F.min("position").alias("position"), text.alias("value"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last")).drop("entry")


def volume_json(spark: SparkSession, path: str) -> DataFrame:
    """(day, n) from JSON objects of day to count, one in a file; keys cut to the day, the later of two wins.

    An object of any length is read in splits, at its commas, and each entry is parsed by
    itself; fails on what is not such an object.
    """
    pieces = positions.numbered_pieces(spark, path, ",")
    alone = F.col("first") & F.col("last")
    pieces = pieces.filter(~(alone & F.col("value").rlike(r"^\s*\{\s*\}\s*$")))
    # Behind a backslash a quote is part of a key.
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    pieces = pieces.withColumn("quotes", F.length(plain) - F.length(F.replace(plain, F.lit('"'))))
    whole = (F.col("quotes") == 2) | alone
    entries = pieces.filter(whole).drop("quotes").unionByName(_joined_pieces(staged(pieces.filter(~whole))))
    text = F.concat(F.when(F.col("first"), "").otherwise("{"), "value", F.when(F.col("last"), "").otherwise("}"))
    # As an element of a list, the entry has to end where the list goes on.
    listed = F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"{_STOP}":0}}]')), "array<map<string, bigint>>", _STRICT | {"mode": "FAILFAST"})
    read = entries.select("position", "value", listed.alias("m"))
    one = (F.size("m") == 2) & (F.size(F.get("m", 0)) == 1) & (F.get(F.map_keys(F.get("m", 1)), 0) == _STOP)
    malformed = F.raise_error(F.concat(F.lit("malformed JSON entry: "), F.substring("value", 1, 200))).cast("string")
    key = F.when(F.coalesce(one, F.lit(False)), F.get(F.map_keys(F.get("m", 0)), 0)).otherwise(malformed)
    rows = read.select("position", F.substring(key, 1, 10).alias("day"), F.get(F.map_values(F.get("m", 0)), 0).alias("n"))
    return rows.groupBy("day").agg(F.max_by("n", "position").alias("n"))


def shard_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(shard, tokenizer, token_budget, day_offsets) from the metadata.json of each shard folder; bad JSON gives nulls."""
    kind = "day_offsets map<string, array<int>>, scrape_truncation struct<tokenizer: string, token_budget: int>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"), F.col("_metadata.file_path").alias("file"))
    shard = F.regexp_replace(F.element_at(F.split("file", "/"), -2), "^shard=", "")
    return rows.select(shard.alias("shard"), F.col("m.scrape_truncation.tokenizer").alias("tokenizer"), F.col("m.scrape_truncation.token_budget").alias("token_budget"), F.col("m.day_offsets").alias("day_offsets"))
