"""The pipeline against a brute-force version of its five stages."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
from tidemark.llm import queries as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def base_failed(text):
    w = WORDS.findall(text or "")
    at: dict = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return len(w) < 10 or 100 * len(again) > 20 * len(w)


def near_duplicates(docs, size=5, percent=80):
    sets = {}
    for d, t in docs.items():
        w = WORDS.findall(low(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(docs)
    for n, a in enumerate(order):
        for b in order[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: t for d, t in docs.items() if find(d) == d}


def contaminated(text, windows):
    w = ALNUM.findall(low(text))
    return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


def targets(sizes, weights=(3, 1, 2)):
    weight = {s: weights[i % 3] for i, s in enumerate(sorted(sizes))}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full


def mixed(docs, source):
    size = {d: len(WORDS.findall(t)) for d, t in docs.items()}
    total = Counter()
    for d in docs:
        total[source[d]] += size[d]
    out = Counter()
    for s, target in targets(total).items():
        rate = target / total[s]
        u = int(hashlib.md5(f"7|s{s}".encode()).hexdigest()[:8], 16) / 2**32
        for i, d in enumerate(sorted((d for d in docs if source[d] == s), key=lambda d: (-size[d], d))):
            out[d] += math.floor((i + 1) * rate + u) - math.floor(i * rate + u)
    return +out


def test_pipeline_equals_brute_force(spark, small):
    rows = q.table(spark, small, "documents").collect()
    source = {r.doc_id: r.source for r in rows}
    docs = {r.doc_id: r.text for r in rows if not base_failed(r.text)}
    docs = near_duplicates(docs)
    windows = set()
    for item in q.table(spark, small, "benchmark").collect():
        w = ALNUM.findall(low(item.text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    docs = {d: t for d, t in docs.items() if not contaminated(t, windows)}
    copies = mixed(docs, source)
    got = corpus_pipeline.run(spark, small).collect()
    assert Counter(r.doc_id for r in got) == copies
    shards: dict[int, list] = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = sorted(((copies[d] * (len(t.encode()) + 1), hashlib.md5(t.encode()).hexdigest()) for d, t in docs.items() if copies[d]), key=lambda x: (-x[0], x[1]))

    def needs(capacity):
        n, room = 0, -1
        for s, _ in sizes:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    greatest = max(sum(r.size for r in part) for part in shards.values())
    assert len(shards) <= 16 and needs(greatest) <= 16 and (needs(greatest - 1) > 16 or greatest == sizes[0][0])


def test_stages_keep_the_columns(spark, small):
    docs = q.table(spark, small, "documents")
    extra = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        extra = step(spark, extra, small)
        assert extra.columns == docs.columns, name


def test_stages_take_an_empty_table(spark, small):
    docs = q.table(spark, small, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, small).count() == 0


def test_stages_take_clashing_columns_and_nulls(spark, small):
    """Extra columns named like the operators' own pass through; rows of nulls do no harm."""
    from pyspark.sql import functions as F

    docs = q.table(spark, small, "documents").limit(60)
    names = ("_rid", "_k", "row", "number", "rid", "copies", "node", "label", "matches", "q_words", "place")
    extra = docs.withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in names})
    nulls = extra.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in extra.schema.fields])
    out = extra.unionByName(nulls).unionByName(extra.limit(5))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, out, small)
        assert out.columns == extra.columns, name
    kept = out.collect()
    assert kept and all(r[n] == f"{n} {r.doc_id}" for r in kept for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, out, small).count() == len(kept)
