"""Corpus news volume by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import day, valid_day


def daily_volume(articles: DataFrame, column: str = "published_date") -> DataFrame:
    """(day, n) over all shards; undated articles are not counted."""
    return articles.filter(valid_day(column)).groupBy(day(column).alias("day")).agg(F.count("*").alias("n"))


def volume_totals(articles: DataFrame, column: str = "published_date") -> DataFrame:
    dated = F.coalesce(valid_day(column), F.lit(False))
    return articles.agg(F.count("*").alias("articles"), F.count_if(~dated).alias("undated"))


def attach(days: DataFrame, volume: DataFrame) -> DataFrame:
    """Adds news (0 where the corpus has none) to rows with a day."""
    return days.join(volume.withColumnRenamed("n", "news"), "day", "left").withColumn("news", F.coalesce("news", F.lit(0)).cast("long"))


def nest(days: DataFrame) -> DataFrame:
    """(event_id, news_daily): the series in order of pos."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "news")))
    return days.groupBy("event_id").agg(F.transform(pairs, lambda x: x["news"]).alias("news_daily"))


def overlapping(days: DataFrame) -> DataFrame:
    """Number of events with news on any of their days."""
    return days.groupBy("event_id").agg(F.max(F.col("news") > 0).alias("some")).agg(F.count_if("some").alias("events_with_news"))


def earliest_shard(shards: DataFrame) -> DataFrame:
    """First day of the least shard name (YYYY-MM or YYYY-MM-DD); null without one."""
    least = F.min(F.when(F.col("shard").rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.col("shard")))
    return shards.agg(least.alias("s")).select(F.when(F.length("s") == 7, F.concat("s", F.lit("-01"))).otherwise(F.col("s")).alias("start"))
