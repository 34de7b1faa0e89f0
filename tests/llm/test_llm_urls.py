"""The classifier of urls: what paths say, labels from pages, lists of words on both sides of their bound."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import urlfilter

SAME = ["zorp", "quux", "fnord", "blarg"]


def _verdicts(spark, urls, **settings):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    return {urls[r.page_id]: r for r in urlfilter.judge(pages, [], **settings).collect()}


def test_path_words_decide(spark):
    """Hosts that say nothing: the path makes the verdict."""
    bad = ["free-spins/casino", "online-casino/jackpot-win", "porn/videos", "cheap-pills/"]
    good = ["news/local", "recipes/bread", "track/parcel-status", "", "garden-forum/"]
    urls = [f"http://{h}.org/{p}" for h, p in zip(SAME * 3, bad + good, strict=False)]
    got = _verdicts(spark, urls)
    assert [got[u].verdict for u in urls] == ["block"] * len(bad) + ["allow"] * len(good)
    assert {"p:casino", "p:jackpot"} <= set(got[urls[1]].tokens)


def test_host_and_path_are_weighed_together(spark):
    urls = ["http://city-news.org/casino", "http://city-news.org/casino/free-spins/jackpot/bonus", "http://casino-bonus.org/news", "http://casino-bonus.org/"]
    got = _verdicts(spark, urls)
    assert [got[u].verdict for u in urls] == ["allow", "block", "block", "block"]


def test_a_long_list_of_words_gives_the_same(spark, monkeypatch):
    urls = [f"http://{a}{b}.net/{b}{a}/x{i}" for i, (a, b) in enumerate((a, b) for a in ("casino", "garden", "poker", "zorp") for b in ("news", "bonus", "farm", "win"))]
    few = {u: (r.verdict, r.tokens) for u, r in _verdicts(spark, urls).items()}
    monkeypatch.setattr(urlfilter, "LISTED_WORDS", 3)
    assert {u: (r.verdict, r.tokens) for u, r in _verdicts(spark, urls).items()} == few


def test_evidence_of_pages(spark):
    text = "One thing happened. Then another did. People talked about it for weeks and weeks. "
    rows = [
        ("u1", f"<html><style>p {{}}</style><p>{text}</p></html>"), ("u2", "<p>Buy now!</p>"), ("u3", None), ("u4", "<script>" + text * 9 + "</script><b>few words here</b>"),
        ("u5", "<p>" + "click here to win the prize now. " * 12 + "</p>"), ("u6", ""), (None, f"<p>{text}</p>"),
    ]
    got = {r.url: r.blocked for r in urlfilter.evidence(spark.createDataFrame([(*r, 1, True) for r in rows], "url string, html string, n int, s boolean")).collect()}
    assert got == {"u1": False, "u2": True, "u4": True, "u5": True, "u6": True, None: False}


def test_evidence_teaches_words_that_no_example_has(spark):
    """Pages label their hosts; the model knows the words on hosts that it has not seen."""
    good, bad = "Some sentence about a topic. Another one that differs. And a third of many words. ", "Win. Win. Win. "
    words = {True: ["glimp", "snarv"], False: ["brool", "tassen"]}
    rows = [(f"http://{w}-{x}{i}.org/{w}/{x}", bad if b else good) for b, ws in words.items() for w in ws for i, x in enumerate("abcdefghijklmnop")]
    labelled = urlfilter.evidence(spark.createDataFrame(rows, "url string, html string"))
    assert labelled.filter("blocked").count() == 32
    told = urlfilter.held_out(labelled).collect()
    right = sum(r.n for r in told if r.blocked == (r.verdict == "block"))
    assert right == sum(r.n for r in told) > 0
    model = urlfilter.fit(labelled, labelled=labelled)
    urls = ["http://new-glimp.de/", "http://new.de/snarv/", "http://new-brool.de/", "http://new.de/tassen/"]
    got = _verdicts(spark, urls, model=model)
    assert [got[u].verdict for u in urls] == ["block", "block", "allow", "allow"]


def test_no_example_is_on_both_sides():
    for table in (urlfilter.EXAMPLES, urlfilter.PATH_EXAMPLES):
        names = [n for t in table.values() for n in t.split()]
        assert len(names) == len(set(names))


@pytest.mark.parametrize("url", ["http://", "x", "", "http:///only/path", "http://" + "a" * 70 + ".org/" + "b" * 5000])
def test_odd_urls(spark, url):
    assert _verdicts(spark, [url])[url].verdict == "allow"
    assert spark.range(1).select(urlfilter.host_of(F.lit(url)).alias("h")).first().h == url.split("://", 1)[-1].split("/")[0] * ("://" in url)
