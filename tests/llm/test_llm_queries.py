"""The training-data queries against their SQL, and those without SQL against brute force."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from compare import differences

from tidemark.llm import queries as q
from tidemark.llm import tokencount


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_matches_sql(spark, small, name):
    assert not differences(q.QUERIES[name](spark, small), q.SQL[name], small)


def _rows(spark, small, name):
    return q.table(spark, small, name).collect()


def test_sharding_is_minimax(spark, small):
    """The greatest shard is as small as an exhaustive greedy search over the same order allows."""
    got = q.op2_sharding(spark, small).collect()
    texts = {r.doc_id: r.text for r in _rows(spark, small, "documents")}
    sizes: dict[str, int] = {}
    for d, t in texts.items():
        digest = hashlib.md5(t.encode()).hexdigest()
        sizes[digest] = sizes.get(digest, 0) + len(t.encode()) + 1
    order = [sizes[g] for g in sorted(sizes, key=lambda g: (-sizes[g], g))]

    def needs(capacity):
        shards, room = 0, -1
        for s in order:
            if s > room:
                shards, room = shards + 1, capacity
            room -= s
        return shards

    capacity = max(order)
    while needs(capacity) > 16:
        capacity += 1
    by_shard: dict[int, list] = {}
    for r in got:
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1
        by_shard.setdefault(r.shard, []).append(r)
    assert len(got) == len(texts) and set(by_shard) <= set(range(16))
    assert max(sum(r.size for r in rows) for rows in by_shard.values()) == capacity
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    homes: dict[str, set] = {}
    for r in got:
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_mix_is_near_its_targets(spark, small):
    rows = q.op1_mixing(spark, small).collect()
    source = {r.doc_id: r.source for r in _rows(spark, small, "documents")}
    taken: dict[str, int] = {}
    for r in rows:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        assert r.copies <= 2
    largest = max(r.size for r in rows)
    target = {source[r.doc_id]: r.target for r in rows}
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert all(abs(taken[s] - target[s]) <= largest for s in target)


def test_url_verdicts_equal_brute_force(spark, small):
    """Rules, counts of all words, segmentation and verdicts in plain Python."""
    import re
    from collections import Counter

    from tidemark.llm import urlfilter

    def rule(host, path):
        found = [(len(r), r, v) for v, r in q.URL_RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        return max(found, default=(0, None, None))

    def parts(url):
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        return host.lower(), re.split("[?#]", rest[len(host) :])[0]

    pages = _rows(spark, small, "pages")
    counts = Counter()
    for page in pages:
        host, path = parts(page.url)
        counts.update(re.findall("[a-z]+", path.lower()) + [w for label in host.split(".") if "-" in label for w in re.findall("[a-z]+", label)])
    floor = max(10, sum(counts.values()) // 1000)
    for w in {*urlfilter.COMMON_WORDS, *(t[2:] for tokens, _ in urlfilter.examples() for t in tokens)}:
        counts[w] = max(counts[w], floor)
    segmenter, bayes = urlfilter.Segmenter(counts), urlfilter.NaiveBayes(urlfilter.examples())
    got = {r.page_id: r for r in q.op4_urlfilter(spark, small).collect()}
    for page in pages:
        r, (host, path) = got[page.page_id], parts(page.url)
        _, expected, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, expected)
        words = ["h:" + w for run in re.findall("[a-z]+", host) for w in segmenter.split(run)] + ["p:" + w for run in re.findall("[a-z]+", path.lower()) for w in segmenter.split(run)]
        assert r.verdict == (verdict or ("block" if bayes.score(words) > 0 else "allow"))


def test_token_counts_equal_the_library(spark, small):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    docs = _rows(spark, small, "documents")
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(q.TOKENIZER))
    got = {r.doc_id: r for r in q.op10_tokencount(spark, small).collect()}
    for d in docs:
        n = len(pieces.encode(d.text))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len(d.text.encode()), n > 4096)
    odd = ["", " ", "  a  b ", "x" * 5000, "a b " * 900, "<s> </s> <unk>", "é " * 1500, "\n\n\t a\u0301 " * 500, "\u2581 x " * 400]
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        whole = pieces.encode if name.endswith(".model") else lambda t, z=Tokenizer.from_file(path): z.encode(t, add_special_tokens=False).ids
        assert tokencount.count_texts(odd, path) == [len(whole(t)) for t in odd]
