"""Domains of events by vote of their tags.

The dictionary (tag, domain) is data of the caller: a table, of any size, in which each
tag belongs to one domain. Listing flags never vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Domains, first wins a tie.
PRIORITY = ("crypto", "sports", "geopolitics", "politics", "finance", "tech", "pop_culture", "science_health_weather", "crime_society")
#: Tags that tell of the listing, not of the topic.
FLAG_WORDS = (
    "hide-from-new", "recurring", "weekly", "monthly", "daily", "yearly", "all", "new", "trending", "featured", "live",
    "neg-risk", "parlays?", "multi-strikes", "game-specials", "combos?", "up-or-down", "close", "mention-markets",
    "tweets-markets", "breaking-news", "prediction-markets", "kpis", "math", r"rewards[\w-]*", r"finance-rewards-\d+",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
FLAG = rf"(?U)^(?:{'|'.join(FLAG_WORDS)}|(?:{'|'.join(MONTHS)})-\d{{1,2}})$"


def listing_flag(tag: Column | str) -> Column:
    return (F.col(tag) if isinstance(tag, str) else tag).rlike(FLAG)


def split_tags(tags: Column | str) -> Column:
    """{topical, flags} of a tag array, in order."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.struct(F.filter(tags, lambda t: ~listing_flag(t)).alias("topical"), F.filter(tags, listing_flag).alias("flags"))


def priorities(spark: SparkSession, order: tuple[str, ...] = PRIORITY) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(d) for d in order])).alias("priority", "domain"))


def ambiguous_tags(dictionary: DataFrame) -> DataFrame:
    """Tags that more than one domain claims; empty for a valid dictionary."""
    return dictionary.groupBy("tag").agg(F.count_distinct("domain").alias("domains")).filter("domains > 1")


def votes(tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(event_id, domain, votes) from (event_id, tag); repeats count."""
    topical = tags.filter(~listing_flag("tag"))
    return topical.join(dictionary, "tag").groupBy("event_id", "domain").agg(F.count("*").alias("votes"))


def classify(tags: DataFrame, dictionary: DataFrame, order: tuple[str, ...] = PRIORITY) -> DataFrame:
    """event_id, domain (most votes, ties by priority, else unknown) and domains (all, by priority)."""
    ranked = votes(tags, dictionary).join(priorities(tags.sparkSession, order), "domain")
    best = ranked.groupBy("event_id").agg(
        F.max_by("domain", F.struct(F.col("votes"), -F.col("priority"))).alias("domain"),
        F.transform(F.array_sort(F.collect_set(F.struct("priority", "domain"))), lambda x: x["domain"]).alias("domains"),
    )
    events = tags.select("event_id").distinct()
    out = events.join(best, "event_id", "left")
    return out.select("event_id", F.coalesce("domain", F.lit(UNKNOWN)).alias("domain"), F.coalesce("domains", F.array().cast("array<string>")).alias("domains"))


def audit(tags: DataFrame, dictionary: DataFrame, order: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Counts: all events, unresolved ones, events by domain, unmapped topical tags by use.

    Ties among unmapped tags are in order of tag, as a table has no first appearance.
    """
    classes = classify(tags, dictionary, order)
    row = lambda kind, name, n: [F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n")]
    whole = classes.agg(F.count("*").alias("n")).select(*row("events", F.lit(""), F.col("n")))
    lost = classes.agg(F.count_if(F.col("domain") == UNKNOWN).alias("n")).select(*row("unresolved", F.lit(""), F.col("n")))
    by = classes.filter(F.col("domain") != UNKNOWN).groupBy("domain").count().select(*row("domain", F.col("domain"), F.col("count")))
    loose = tags.filter(~listing_flag("tag")).join(dictionary, "tag", "left_anti").groupBy("tag").count()
    return whole.unionAll(lost).unionAll(by).unionAll(loose.select(*row("unmapped", F.col("tag"), F.col("count"))))


def top_unmapped(tags: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """The k most used unmapped tags with their rank; only these meet in one task."""
    loose = audit(tags, dictionary).filter("kind = 'unmapped'")
    order = [F.col("n").desc(), F.col("name")]
    return loose.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
