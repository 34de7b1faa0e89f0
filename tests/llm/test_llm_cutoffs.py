"""Cutoffs in force: labels that certify some, in the query and in the pipeline; lists of names on both sides of their bound; clashing columns."""

from __future__ import annotations

import numpy as np
import pytest
from compare import TABLES, differences

import corpus_pipeline
from tidemark.llm import chat, queries, quality, storage, tokencount

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labelled(spark, small, tmp_path_factory):
    """Plain texts, and ones full of symbols or of pipes; enough labels in one language, few in another."""
    draw = np.random.default_rng(17)
    rows, labels = [], []
    for i in range(2600):
        words = [f"w{x}" for x in draw.integers(0, 5000, int(draw.integers(14, 30)))]
        bad = i % 7 == 0
        if bad:
            words = [w + (" # $" if i % 2 else " |") for w in words]
        lang = "en" if i % 13 else "de"
        rows.append((i, " ".join(words), lang, f"s{i % 3}", 0))
        if i % 10:
            labels.append((i, int(not bad), 0))
    rows += [(3000, None, "en", "s0", 0), (3001, "", None, "s0", 0), (3002, "a | b " * 9, None, None, 0)]
    folder = tmp_path_factory.mktemp("labelled")
    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name in set(TABLES) - {"documents", "labels"}:
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder), rows


def test_cutoffs_act_and_equal_the_sql(spark, labelled):
    folder, rows = labelled
    assert not differences(queries.op6_quality(spark, folder), queries.SQL["op6_quality"], folder)
    told = {r.doc_id: r for r in queries.op6_quality(spark, folder).collect()}
    cut = {d for d, r in told.items() if not r.kept and not r.base_failed}
    assert len(cut) > 300 and all(d % 7 == 0 for d in cut if d < 3000)


def test_the_pipeline_drops_by_cutoffs(spark, labelled):
    """The first stage keeps what the SQL keeps, cutoffs included."""
    folder, rows = labelled
    name, stage = corpus_pipeline.STAGES[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = stage(spark, docs, folder)
    kept = {r.doc_id for r in queries.op6_quality(spark, folder).filter("kept").collect()}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept and len(kept) < 2400


def test_few_labels_give_no_cutoff(spark, labelled):
    folder, _ = labelled
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    assert quality.judge(docs, labels.filter("doc_id < 200")).filter("not kept and not base_failed").isEmpty()
    assert quality.judge(docs, labels.limit(0)).filter("not kept and not base_failed").isEmpty()


@pytest.mark.parametrize("rows", [0, 10])
def test_lists_of_names_beyond_their_bound_are_joined(spark, rows):
    names = spark.range(10).withColumnRenamed("id", "rid")
    few = storage.broadcast_if_small(names, rows)
    df = spark.range(40).withColumnRenamed("id", "rid").join(few, "rid", "left_anti")
    assert df.count() == 30 and ("BroadcastHashJoin" in df._jdf.queryExecution().toString() or rows == 0)


def test_clashing_columns_of_chats_and_token_counts(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "one two", 9, "x"), (None, None, 9, "x"), (1, "one two", 9, "x")], "doc_id long, text string, n_tokens int, n_bytes string")
    counted = tokencount.count_tokens(docs, public_tokenizers.path(queries.TOKENIZER))
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens"] and sorted(str(r.doc_id) for r in counted.collect()) == ["1", "1", "None"]
    rows = spark.createDataFrame([(1, 0, "user", "hi", 3, "r"), (1, 1, "assistant", "ho", 4, "r"), (2, 0, None, None, 5, "r")], "conv_id long, turn int, role string, text string, record int, formatted string")
    out = chat.digests(chat.format_records(chat.conversation_records(rows), "conv_id"), "conv_id").collect()
    assert {r.conv_id: r.n_turns for r in out} == {1: 2, 2: 1}
