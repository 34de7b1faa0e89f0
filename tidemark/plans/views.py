"""Views of the driver's tables in the shapes the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One binary question per user: belief is the capped mean value of the day."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    rows = events.groupBy("event_id", "day").agg(F.round(F.least(F.lit(1.0), F.sum("value") / F.count("*") / 500.0), 9).alias("p"), F.count("*").alias("n"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("event_id").orderBy("day")) - 1)


DAILY_BELIEF = """daily_belief AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY day) - 1 AS pos FROM (
    SELECT user_id AS event_id, strftime(ts, '%Y-%m-%d') AS day,
      round(least(1.0, sum(value) / count(*) / 500.0), 9) AS p, count(*) AS n
    FROM events GROUP BY 1, 2))"""

#: Event types, the legs of the multi-outcome question.
LEGS = ("click", "error", "purchase", "signup", "view")


def leg_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multi-outcome question per user: legs are event types, a leg's belief its share of the day."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    counts = [F.count_if(F.col("event_type") == leg).alias(leg) for leg in LEGS]
    wide = events.groupBy("event_id", "day").agg(*counts, F.count("*").alias("n"))
    wide = wide.withColumn("pos", F.row_number().over(Window.partitionBy("event_id").orderBy("day")) - 1)
    long = wide.unpivot(["event_id", "day", "pos", "n"], list(LEGS), "leg", "c")
    return long.select("event_id", "day", "pos", "leg", (F.col("c") / F.col("n")).alias("p"))


LEG_SHARE = f"""leg_share AS (
  SELECT d.event_id, d.day, d.pos, t.leg, coalesce(c.n, 0) * 1.0::DOUBLE / d.n AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY day) - 1 AS pos FROM
    (SELECT user_id AS event_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)) d
  CROSS JOIN (VALUES {", ".join(f"('{leg}')" for leg in LEGS)}) t(leg)
  LEFT JOIN (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3) c
    ON c.user_id = d.event_id AND c.day = d.day AND c.event_type = t.leg)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as dated articles."""
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("published_date"), F.date_format("ts", "yyyy-MM").alias("shard"))


VOLUME = "volume AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)"

RESOLUTION = "2024-02-01"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the part name and its type as tags of an event."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("event_id"), F.explode(F.array_append(F.split("p_name", " "), F.lower("p_type"))).alias("tag"))


TAGS = "tags AS (SELECT p_partkey AS event_id, unnest(list_append(string_split(p_name, ' '), lower(p_type))) AS tag FROM part)"

#: The query's dictionary: part words stand for tags.
DICTIONARY = {
    "crypto": ("ring", "gizmo"), "sports": ("bolt", "red"), "politics": ("plate", "large"), "finance": ("economy", "promo"),
    "tech": ("widget", "gear"), "crime_society": ("anvil", "cold"),
}


def dictionary(spark: SparkSession) -> DataFrame:
    pairs = [F.struct(F.lit(t).alias("tag"), F.lit(d).alias("domain")) for d, words in DICTIONARY.items() for t in words]
    return spark.range(1).select(F.explode(F.array(*pairs)).alias("x")).select("x.tag", "x.domain")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, dated by id."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    when = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int"))
    rows = d.join(e, d.doc_id == e.vec_id).withColumn("_d", when)
    return rows.select(
        F.col("doc_id").alias("article_id"), "text", F.col("source").alias("title"), F.concat(F.lit("https://example.org/"), F.col("doc_id")).alias("url"),
        F.lit("").alias("summary"), F.date_format("_d", "yyyy-MM-dd").alias("published_date"), F.date_format("_d", "yyyy-MM").alias("shard"), "embedding",
    )


ARTICLES = """articles AS (SELECT d.doc_id AS article_id, d.text, d.source AS title,
  strftime(DATE '2024-01-01' + CAST(d.doc_id % 90 AS INTEGER), '%Y-%m-%d') AS published_date,
  strftime(DATE '2024-01-01' + CAST(d.doc_id % 90 AS INTEGER), '%Y-%m') AS shard, e.embedding
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"""


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rollouts of a group."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("group_index"), F.col("l_linenumber").alias("pos"), (F.col("l_extendedprice") / 1000.0).alias("reward"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("correct"), "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus",
    )


REWARDS = """rewards AS (SELECT l_orderkey AS group_index, l_linenumber AS pos, l_extendedprice / 1000.0::DOUBLE AS reward,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS correct, l_discount, l_tax, l_quantity, l_returnflag, l_linestatus FROM lineitem)"""
