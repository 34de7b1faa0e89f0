"""The window join and the vector index against a plain scan."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import vector_index, window_join
from tidemark.plans.queries import retrieval

ARTICLE = "article_id long, published_date string, embedding array<float>"
ASK = "query_id long, vector array<double>, start string, cutoff string"


def _day(i):
    return str(np.datetime64("2024-01-01") + int(i))


def _articles(seed, n, dim=6, centres=1):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dim)) * 4
    rows = [(i, _day(draw.integers(70)), [float(np.float32(x)) for x in middle[draw.integers(centres)] + draw.normal(size=dim)]) for i in range(n)]
    rows += [(n, None, [1.0] * dim), (n + 1, "soon", [1.0] * dim), (n + 2, "2024-01-03", None), (n + 3, "2024-02-01", [0.0] * dim)]
    return rows + [(n + 4 + i, "2024-01-20", rows[0][2]) for i in range(40)]


def _asks(seed, n, dim=6):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lo, hi = sorted(draw.integers(-10, 90, 2))
        rows.append((i, draw.normal(size=dim).tolist(), None if i % 4 == 0 else _day(lo), None if i % 6 == 0 else _day(hi)))
    return [*rows, (n, [0.0] * dim, None, None), (n + 1, [1.0] * dim, "2024-02-02", "2024-02-01"), (n + 2, None, None, None)]


def brute(articles, asks, k, dated=True):
    out = []
    for q, vector, start, cutoff in asks:
        if vector is None:
            continue
        v = np.array(vector)
        v = v / (np.linalg.norm(v) or 1.0)
        fits = []
        for a, d, e in articles:
            known = d is not None and d[:4] == "2024"
            if e is None or dated and not (start is None and cutoff is None if not known else (start is None or d >= start) and (cutoff is None or d <= cutoff)):
                continue
            fits.append((-round(float(v @ np.array(e)), 6), a))
        out += [(q, r, a, -s) for r, (s, a) in enumerate(sorted(fits)[:k], 1)]
    return sorted(out)


def rows_of(hits):
    return sorted((r.query_id, r.rank, r.article_id, round(r.score, 6) + 0.0) for r in hits.collect())


@pytest.mark.parametrize("settings", [{}, {"bin_days": 3, "block": 4, "part": 16}, {"bin_days": 500, "block": 1}], ids=["usual", "many parts", "one bin"])
def test_window_join_equals_brute_force(spark, settings):
    articles, asks = _articles(1, 300), _asks(2, 30)
    got = window_join.window_join(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(asks, ASK), 4, **settings)
    assert rows_of(got) == brute(articles, asks, 4)


def test_window_join_of_empty_sides(spark):
    articles, asks = spark.createDataFrame(_articles(1, 20), ARTICLE), spark.createDataFrame(_asks(2, 5), ASK)
    assert window_join.window_join(articles.limit(0), asks).count() == 0 and window_join.window_join(articles, asks.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [1, 12, 1000])
def test_index_equals_a_scan(spark, tmp_path, cells):
    articles, asks = _articles(3, 300), [(q, v, None, None) for q, v, *_ in _asks(4, 25)]
    vector_index.build(spark.createDataFrame(articles, ARTICLE), str(tmp_path), cells)
    hits, work = vector_index.search(spark, str(tmp_path), spark.createDataFrame(asks, ASK), 6, query_block=10)
    assert rows_of(hits) == brute(articles, asks, 6, dated=False)
    assert {r.query_id for r in work.collect()} == {q for q, v, *_ in asks if v is not None}


def test_index_skips_cells(spark, tmp_path):
    """Twenty tight clusters: a query reads a small part of the index, and cells nobody asks for are not in the scan."""
    draw = np.random.default_rng(5)
    middle = draw.normal(size=(20, 16))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    articles = [(i, "2024-01-01", (middle[i % 20] + 0.01 * draw.normal(size=16)).tolist()) for i in range(2000)]
    asks = [(i, middle[i].tolist(), None, None) for i in range(5)]
    vector_index.build(spark.createDataFrame(articles, ARTICLE), str(tmp_path), 64)
    hits, work = vector_index.search(spark, str(tmp_path), spark.createDataFrame(asks, ASK), 5)
    plain = retrieval.search(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(asks, ASK), 5)
    assert rows_of(hits) == rows_of(plain)
    assert all(r.read < r.vectors // 4 and r.scanned < r.cells // 2 for r in work.collect())


def test_index_of_nothing(spark, tmp_path):
    vector_index.build(spark.createDataFrame([], ARTICLE), str(tmp_path))
    hits, work = vector_index.search(spark, str(tmp_path), spark.createDataFrame(_asks(1, 3), ASK))
    assert hits.count() == 0 and work.count() == 0
