"""What must hold at any size: copies of texts, collisions of names, sorts of hostile strings."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, storage, suffixdedup


def _staged_bytes(spark) -> int:
    top = storage.application_folder(spark, "staged").removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_benchmark_blocks_copy_no_texts(spark):
    """Thirty blocks over documents of random words: what is staged is small, and no match is lost."""
    draw = np.random.default_rng(7)
    word = lambda: uuid.UUID(bytes=draw.bytes(16)).hex
    texts = [" ".join(word() for _ in range(400)) for _ in range(60)]
    items = [(f"i{k:03d}", " ".join(texts[2 * k % 60].split()[5 : 5 + 12 + k % 5])) for k in range(60)] + [("none", None), ("short", "zz")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert sum(1 for _ in decontamination._blocks(bench.withColumnRenamed("item_id", "item"), 10, 1300)) >= 30
    before = _staged_bytes(spark)
    found = {r.doc_id: r for r in decontamination.find_matches(docs, bench, block_bytes=1300).collect()}
    assert _staged_bytes(spark) - before < sum(map(len, texts)) // 10
    whole = {r.doc_id: r for r in decontamination.find_matches(docs, bench).collect()}
    assert {d: (r.n_words, r.n_hit, r["items"]) for d, r in found.items()} == {d: (r.n_words, r.n_hit, r["items"]) for d, r in whole.items()}
    assert sum(len(r["items"]) for r in found.values()) == 60


def test_a_block_is_never_too_large(spark):
    """One item over the bound is a block of its own, whatever lies around it."""
    items = [(str(k), "w " * (5 + k)) for k in range(40)] + [("large", "word " * 3000)]
    bench = spark.createDataFrame(items, "item string, text string")
    sizes = [(sum(len(t) + 64 for t in b.texts), b.ids) for b, in ((b,) for b in decontamination._blocks(bench, 10, 500))]
    assert sorted(i for _, ids in sizes for i in ids) == sorted(i for i, _ in items)
    assert [ids for size, ids in sizes if size > 500] == [["large"]]


def removed(texts: list[str], width: int) -> list[bytes]:
    held = [t.encode() for t in texts]
    first: dict[bytes, int] = {}
    for i, t in enumerate(held):
        for s in range(len(t) - width + 1):
            first.setdefault(t[s : s + width], i)
    out = []
    for i, t in enumerate(held):
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if first[t[s : s + width]] < i:
                gone[s : s + width] = b"\1" * width
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def test_colliding_names_of_texts_lose_nothing(spark, monkeypatch):
    """Names of texts that all collide at first, and in part after that."""
    real = suffixdedup._text_name
    weak = {0: lambda t: F.lit(7).cast("long"), 1: lambda t: F.length(t).cast("long")}
    monkeypatch.setattr(suffixdedup, "_text_name", lambda t, seed: weak[seed](t) if seed in weak else real(t, seed))
    passage = "The quick brown fox jumps over the lazy dog, again and again. "
    texts = [passage + "one two three", "one " + passage, passage + "tail two three", "short", "", "other text " * 9, passage + "one two three", "x" * 80 + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffixdedup.remove_later(docs).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 50)


@pytest.mark.parametrize("kind", ["random", "two letters", "one letter", "periodic", "copies", "tails", "few"])
def test_sorted_suffixes(kind):
    draw = np.random.default_rng(9)
    data = {
        "random": draw.integers(0, 256, 6000), "two letters": draw.integers(97, 99, 6000), "one letter": np.full(3000, 97), "periodic": np.tile([97, 98, 99, 97, 98], 900),
        "copies": np.tile(draw.integers(0, 256, 500), 9), "tails": np.concatenate([np.r_[np.tile([120], 44), draw.integers(97, 100, 6)] for _ in range(90)]), "few": draw.integers(0, 256, 70),
    }[kind].astype(np.uint8)
    start = draw.permutation(len(data) - 50 + 1)
    raw = data.tobytes()
    order, group = suffixdedup.sort_suffixes(data, start, 50)
    held = [raw[start[o] : start[o] + 50] for o in order]
    assert sorted(order.tolist()) == list(range(len(start))) and held == sorted(held)
    assert [a == b for a, b in zip(held, held[1:], strict=False)] == (group[1:] == group[:-1]).tolist()


def test_sorting_nothing():
    order, group = suffixdedup.sort_suffixes(np.zeros(0, np.uint8), np.zeros(0, np.int64), 50)
    assert len(order) == 0 == len(group)
