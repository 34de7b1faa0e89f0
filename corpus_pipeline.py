"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
its result is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``. The last returns the shards' manifest: the
row's id, source, language and size, the digest of its text, its shard and its slot.

Null texts have no words, so the quality rules drop them, as they do empty ones. Null ids,
sources and languages stay what they are; ties, repeated rows and long texts are handled as
the operators say. Extra columns pass through all stages but the last, whatever their
names. An empty table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, mixing, quality, sharding
from tidemark.llm.queries import table
from tidemark.llm.storage import release, stage

NEAR_WORDS, NEAR_PERCENT = 5, 80
SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a certified cutoff go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest id."""
    return jaccard.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window of ten words go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def sharding_manifest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; equal texts share a shard."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", "source", "lang", "n_chars", size.alias("size"), F.md5("text").alias("group"))
    return sharding.assign(rows, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_manifest),
]

#: The near-duplicate classes (a transitive closure) and the shard search have no SQL of
#: bounded cost; tests/llm compares the pipeline with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    return docs
