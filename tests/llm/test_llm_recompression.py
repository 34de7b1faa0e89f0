"""The rounds of recompression: names are global, what repeats shares its symbols, and nothing is lost on hostile texts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import recompression as rc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return Counter(out)


def hostile(seed, n=140):
    draw = np.random.default_rng(seed)
    passages = [" ".join(f"p{k}w{i}" for i in range(draw.integers(20, 90))) for k in range(8)]
    rows = []
    for i in range(n):
        kind, size = i % 9, int(draw.integers(1, 120))
        noise = lambda m, v=40: " ".join(f"n{x}" for x in draw.integers(0, v, m))  # noqa: B023, E731
        text = {
            0: lambda: "a " * size, 1: lambda: "a b " * size, 2: lambda: noise(size, 3), 3: lambda: noise(size, 10_000) + " " + passages[draw.integers(8)],
            4: lambda: passages[draw.integers(8)] + "\n" + noise(size) + "\t" + passages[draw.integers(8)], 5: lambda: passages[draw.integers(8)] * 1 + " " + passages[draw.integers(8)],
            6: lambda: "a " * int(draw.integers(30, 40)) + noise(5) + " a" * int(draw.integers(30, 40)), 7: lambda: " ".join(passages[draw.integers(8)].split()[int(draw.integers(9)) :]), 8: lambda: noise(size, 10_000) + " x" * 34,
        }[kind]()
        rows.append((i, text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 2, rows[3][1]), (None, rows[4][1])]


@pytest.mark.parametrize("width", [2, 5, 35])
def test_hostile_texts_equal_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(rc, "BUNDLE_BYTES", 700)
    rows = hostile(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rc.remove_repeats(df, width=width).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter(map(tuple, got)) == brute(rows, width)


def test_names_are_the_same_in_all_bundles(spark, monkeypatch):
    """A passage in many documents: inside it all have the same symbols, which are shared; words of one document are not."""
    monkeypatch.setattr(rc, "BUNDLE_BYTES", 500)
    passage = " ".join(f"w{i}" for i in range(80))
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(40)) + " " + passage + " " + " ".join(f"d{i}y{k}" for k in range(40))) for i in range(12)]
    texts = spark.createDataFrame(rows, "rid long, text string").repartition(4)
    found = rc.compressed(texts, 35, 4).collect()
    inside = set()
    for r in found:
        length, lo, hi = (np.frombuffer(x, np.int32).astype(np.int64) for x in (r.length, r.lo, r.hi))
        shared, at = np.frombuffer(r.shared, np.uint8) > 0, np.cumsum(length) - length
        assert length.sum() == 160
        ends = np.r_[(at + hi)[1:], 161]
        core = (at - lo >= 40) & (ends <= 120)
        assert core.sum() > 10 and shared[core].all()
        inside.add(tuple(zip(at[core].tolist(), length[core].tolist(), strict=True)))
        merged = (length > 1) & ((ends <= 40) | (at - lo >= 120))  # told by what the document holds beside the passage
        assert merged.any() and not shared[merged].any()
    assert len(found) == 12 and len(inside) == 1


def test_rounds_shorten(spark):
    b = rc.Borders(np.random.default_rng(0).integers(1, 1 << 60, 4000).astype(np.uint64), np.zeros(4000, np.int64))
    sizes = [len(b.name)]
    for k in range(4):
        b.round(k)
        sizes.append(len(b.name))
        assert b.lengths().sum() == 4000 and (b.lo <= b.at).all() and (b.hi >= b.at).all()
    assert all(y < 0.85 * x for x, y in zip(sizes, sizes[1:], strict=False))
