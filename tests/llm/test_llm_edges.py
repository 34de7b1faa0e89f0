"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontamination, jaccard, mixing, quality, recompression, sharding, suffixdedup, textarrays, tokencount, urlfilter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, part int, rid string, found string, node int"
PASSAGE = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(80))
CASES = [
    (1, PASSAGE + " tail one", "a", "en"), (2, "head two " + PASSAGE, "a", "en"), (3, None, "b", None), (4, "", None, "en"), (None, PASSAGE, "a", "en"),
    (6, "one", "b", "de"), (6, "one", "b", "de"), (7, "x " * 3000, "b", "en"), (8, OTHER + " " + OTHER, "c", "en"), (9, OTHER, "c", "en"),
    (10, "\t\n  \x0b", "c", "en"), (11, "é" * 60 + " " + PASSAGE[:100], "c", "fr"), (11, PASSAGE, "c", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*c, 0, 1, "r", "f", 2) for c in CASES], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return Counter(map(tuple, rows))


def test_recompression(docs, none):
    words = [WORDS.findall(t or "") for _, t, *_ in CASES]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for (d, *_), w in zip(CASES, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        expected.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = recompression.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert counted(got) == counted(expected)
    assert recompression.remove_repeats(none).count() == 0


def rounds_of(word, row):
    """Symbols after all rounds, in one process: new ones keep their fingerprints as names."""
    b = recompression.Borders(word, row)
    for k in range(recompression.ROUNDS):
        b.round(k)
    return b


@pytest.mark.parametrize("n_symbols", [2, 3, 40])
def test_recompression_anchors_are_consistent(n_symbols):
    """Equal windows have the same anchor at the same place, or both have none."""
    draw = np.random.default_rng(n_symbols)
    word = draw.integers(1, 1 << 60, n_symbols, dtype=np.int64).astype(np.uint64)[draw.integers(0, n_symbols, 3000)]
    word[2000:2400] = word[100:500]
    row = np.repeat([0, 1, 2], 1000)
    first = recompression._starts(row, 35)
    key, place, anchor = recompression.anchors(word, rounds_of(word, row), first, 35)
    found: dict = {}
    for p, a in zip(first, anchor, strict=True):
        mine = None if a < 0 else (int(key[a]), int(place[a] - p))
        assert found.setdefault(word[p : p + 35].tobytes(), mine) == mine


def test_recompression_anchors_before_periodic_tails():
    """A window that ends within a run or a period has the same anchor however far that goes on."""
    draw = np.random.default_rng(7)
    name = draw.integers(1, 1 << 60, 4000, dtype=np.int64).astype(np.uint64)
    docs = []
    for case in range(200):
        head, tail = name[draw.integers(0, 4000, 60 - case % 20)], name[draw.integers(0, 4000, 1 + case % 3)]
        for length in (30, 31, 37, 52):
            docs.append(np.r_[head, np.resize(tail, length), name[draw.integers(0, 4000, 20)]])
    word, row = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    first = recompression._starts(row, 35)
    key, place, anchor = recompression.anchors(word, rounds_of(word, row), first, 35)
    found: dict = {}
    for p, a in zip(first, anchor, strict=True):
        mine = None if a < 0 else (int(key[a]), int(place[a] - p))
        assert found.setdefault(word[p : p + 35].tobytes(), mine) == mine


def test_suffix_dedup(docs, none):
    texts = [(d, (t or "").encode()) for d, t, *_ in CASES]
    least: dict = {}
    for d, b in texts:
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], 1 << 62), 1 << 61 if d is None else d)
    expected = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < (1 << 61 if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        expected.append((d, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixdedup.remove_later(docs).collect()]
    assert counted(got) == counted(expected)
    assert suffixdedup.remove_later(none).count() == 0


def test_suffix_sort_orders_suffixes():
    draw = np.random.default_rng(1)
    data = draw.integers(97, 99, 2000).astype(np.uint8)
    data[500:900] = data[0:400]
    start = np.arange(1900)
    order, group = suffixdedup.sort_suffixes(data, start, 50, shallow=8)
    raw = data.tobytes() + bytes(60)
    strings = [raw[s : s + 50] for s in order]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings, strings[1:], strict=False)] == (group[1:] == group[:-1]).tolist()


def test_blind_trie():
    trie = suffixdedup.BlindTrie(4)
    texts = [b"abcd", b"abca", b"abcd", b"zbcd", b"aacd", b"abda"]
    for i, t in enumerate(texts):
        trie.add(t, i)
    assert [texts[x[0]] for x in trie.leaves()] == sorted(set(texts))


def test_decontamination(spark, docs, none):
    items = [("7", " ".join(PASSAGE.split()[:14])), ("70", "ONE!"), ("8", None), ("9", "!!"), ("7", "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (1 << 20, 40):
        rows = decontamination.find_matches(docs, bench, block_bytes=size).collect()
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows)
        assert got[1, 62, 15, ("7", "70")] == 1 and got[2, 62, 14, ("7",)] == 1 and got[6, 1, 1, ("70",)] == 2
        assert got[8, 160, 22, ("7",)] == 1 and got[3, 0, 0, ()] == 1 and got[10, 0, 0, ()] == 1
    assert decontamination.decontaminate(docs, bench).columns == docs.columns
    assert decontamination.decontaminate(docs, bench).filter("doc_id in (1, 2, 6, 8)").count() == 0
    assert decontamination.find_matches(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


def brute_classes(rows, size, percent):
    sets = []
    for d, t in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=d) if sets[i] else d))
    return out


def test_jaccard(spark, docs, none):
    rows = [(d, t) for d, t, *_ in CASES]
    got = jaccard.classes(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert counted(got) == counted(brute_classes(rows, 4, 85))
    assert jaccard.classes(none).count() == 0
    assert jaccard.keep_one(docs).columns == docs.columns and jaccard.keep_one(none).count() == 0


@pytest.mark.parametrize(("length", "copies", "edits", "size", "percent"), [(40, 40, 1, 4, 85), (120, 60, 2, 5, 80), (1200, 20, 20, 4, 85)])
def test_jaccard_in_large_groups(spark, length, copies, edits, size, percent):
    """Near copies of one text: many do not link with each other, only with the text or a neighbour."""
    draw = np.random.default_rng(length)
    base = [f"b{i}" for i in range(length)]
    rows = [(1000, " ".join(base))]
    for k in range(copies):
        words = list(base)
        for at in draw.choice(length, edits, replace=False):
            words[at] = f"c{k}x{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.classes(df, size, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert counted(got) == counted(brute_classes(rows, size, percent))


def test_jaccard_links_between_batches_of_a_large_group():
    """A mapper holds a large group; another holds a few sets that link with a member each, by that group's signature only."""
    parts, (here, there) = 3, ([], [])
    for f in range(20):
        base = [f"f{f}b{i}" for i in range(12)]
        here += [" ".join([*base, f"f{f}m{k}x0"]) for k in range(30)]
        there += [" ".join([here[-30 + k], *(f"f{f}o{k}x{i}" for i in range(3))]) for k in range(1, 30, 3)]
    nodes, sent = [], []
    for texts in (here, there):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        for chunk in textarrays.chunks(batch.column("text")):
            nodes += jaccard.node_of(*jaccard.shingle_sets(chunk, 1), chunk.rows)[1].tolist()
        sent += jaccard._send_signatures(1, 75, parts)([batch])
    deal = lambda rows, run: [run(t) for p in range(parts) if len(t := rows.filter(pc.equal(rows["part"], p)))]
    paired = pa.concat_tables(deal(pa.Table.from_batches(sent), jaccard._pair_up(parts)))
    marks, pairs = {}, set()
    for row in pa.concat_tables(deal(paired, jaccard._unpack_pairs)).to_pylist():
        pairs.add((row["u"], row["v"]))
        if row["u"] == row["v"]:
            marks.setdefault(row["u"], set()).add(row["sig"])
    for f in range(20):
        for n, k in enumerate(range(1, 30, 3)):
            a, b = nodes[30 * f + k], nodes[600 + 10 * f + n]
            assert (min(a, b), max(a, b)) in pairs or marks.get(a, set()) & marks.get(b, set())


def test_signatures_are_shared_by_linked_sets():
    draw = np.random.default_rng(5)
    for _ in range(300):
        n = int(draw.integers(3, 400))
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
        b = a[draw.random(len(a)) > draw.random() * 0.2]
        both = len(b)
        if not both or 100 * both < 85 * len(a):
            continue
        if both == len(a):
            continue
        value, row = np.concatenate([a, b]), np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
        key, owner = jaccard.signatures(value, row, 2, 85)
        assert set(key[owner == 0]) & set(key[owner == 1])


def test_quality_cutoffs_respect_their_bound(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)) if i % 4 else " ".join(f"w{j}#{i}" for j in range(20)), "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0 or i < 8)) for i in range(2000)], "doc_id long, quality int")
    strict = quality.judge(df, labels, alpha=0.01).filter("not kept and not base_failed").count()
    loose = quality.judge(df, labels, alpha=0.08).filter("not kept and not base_failed").count()
    assert strict == 0 and loose == 500
    kept = quality.keep_good(df, labels, alpha=0.08)
    assert kept.count() == 1500 and kept.columns == df.columns


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((50, 0, 0.1), (200, 7, 0.1), (1000, 30, 0.05)):
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("t")).first().t
        assert got == pytest.approx(exact, rel=1e-9)


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (99, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert len(got) == len({c[0] for c in CASES})
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[7].n_repeat_words == 3000 and got[7].base_failed
    assert got[1].kept and got[1].n_repeat_words == 0
    assert quality.judge(none, labels).count() == 0 and quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_mixing_and_sharding(spark, docs, none):
    narrow = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    rows = mixing.plan(narrow).collect()
    assert len(rows) == len(CASES) and all(0 <= r.copies <= 2 for r in rows)
    assert [tuple(r) for r in sorted(mixing.plan(narrow).collect(), key=str)] == [tuple(r) for r in sorted(rows, key=str)]
    assert mixing.plan(narrow.limit(0)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    placed = sharding.assign(sharding.text_rows(docs), 4).collect()
    assert len(placed) == len(CASES)
    for k in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == k) == list(range(sum(r.shard == k for r in placed)))
    assert sharding.assign(sharding.text_rows(none), 4).count() == 0


def test_minimax_search_narrows_to_the_exact_answer(spark):
    draw = np.random.default_rng(3)
    ends = np.cumsum(draw.integers(1, 50, 3000))
    frame = spark.createDataFrame([(int(e),) for e in ends], "end long")
    largest = int(np.max(np.diff(np.r_[0, ends])))
    exact = sharding.smallest_capacity(ends, 7, max(largest, -(-int(ends[-1]) // 7)))
    for summary in (20, 200, 100_000):
        capacity, cuts = sharding.minimax_cuts(frame, 7, largest, int(ends[-1]), summary)
        assert capacity == exact and len(cuts) <= 7 and np.max(np.diff(np.r_[0, cuts])) <= exact


def test_urls(spark):
    urls = [(1, "https://WWW.Casino-Win.example.ORG/a?b"), (2, None), (3, "no scheme"), (4, "http://theonlinecasino.net#x"), (5, "x://"), (6, "http://a.de://b/c")]
    pages = spark.createDataFrame(urls, "page_id int, url string")
    got = {r.page_id: r for r in urlfilter.judge(pages, [("allow", "net/de/")]).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.casino-win.example.org", "/a", None, "block")
    assert [(got[i].host, got[i].path) for i in (2, 3, 5, 6)] == [("", ""), ("", ""), ("", ""), ("a.de:", "//b/c")]
    assert got[4].verdict == "block" and "h:casino" in got[4].tokens
    assert all(got[i].verdict == "allow" and got[i].rule is None for i in (2, 3, 5))
    assert urlfilter.judge(pages.limit(0), []).count() == 0
    odd = [(1, None, 7, "x"), (1, None, 7, "x"), (2, "http://" + "a" * 300_000 + "/" + "b" * 70, 7, "x"), (None, "http://casino-bonus.de/", 7, "x")]
    clash = spark.createDataFrame(odd, "page_id int, url string, block int, host string")
    rows = urlfilter.judge(clash, [("block", "de/")]).collect()
    assert sorted((str(r.page_id), r.verdict) for r in rows) == [("1", "allow"), ("1", "allow"), ("2", "allow"), ("None", "block")]


def test_viterbi_equals_exhaustive_splitting():
    import itertools

    draw = np.random.default_rng(2)
    words = {"".join(w): int(draw.integers(1, 50)) for n in (1, 2, 3, 4) for w in itertools.islice(itertools.product("ab", repeat=n), 0, None, 3)}
    segmenter = urlfilter.Segmenter(words)
    for _ in range(60):
        name = "".join(draw.choice(list("ab"), int(draw.integers(1, 11))))
        splits = []
        for cuts in itertools.product((0, 1), repeat=len(name) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
            splits.append([name[a:b] for a, b in itertools.pairwise(at)])
        cost = lambda split: sum(map(segmenter.cost_of, split))
        found = segmenter.split(name)
        assert "".join(found) == name and cost(found) == pytest.approx(min(map(cost, splits)))


def test_naive_bayes_equals_counts_by_hand():
    from math import log

    model = urlfilter.NaiveBayes([(["a", "b"], True), (["a"], True), (["b", "c"], False)], prior=0.25, smoothing=1)
    # block: a 2, b 1, c 0 of 3, with smoothing of 6; allow: a 0, b 1, c 1 of 2, of 5
    assert model.odds == pytest.approx({"a": log((3 / 6) / (1 / 5)), "b": log((2 / 6) / (2 / 5)), "c": log((1 / 6) / (2 / 5))})
    assert model.score(["a", "c", "c", "new"]) == pytest.approx(log(1 / 3) + model.odds["a"] + 2 * model.odds["c"])


def test_url_model_generalises_to_held_out_hosts():
    known = urlfilter.examples()
    order = np.random.default_rng(1).permutation(len(known))
    right = 0
    for k in range(10):
        held = set(order[k::10].tolist())
        model = urlfilter.NaiveBayes([known[i] for i in range(len(known)) if i not in held])
        right += sum((model.score(known[i][0]) > 0) == known[i][1] for i in held)
    assert right / len(known) >= 0.85
    model = urlfilter.NaiveBayes(known)
    # Words of both kinds of hosts, none of which decides alone.
    assert model.score(["h:free", "h:win", "h:bonus"]) > 0 > model.score(["h:free", "h:news"])
    assert model.score(["h:download"]) < 0 and model.score(["h:spam", "h:farm"]) > 0 > model.score(["h:organic", "h:farm"])


def test_url_labels_of_the_caller_count(spark):
    pages = spark.createDataFrame([(1, "http://zorp-quux.org/"), (2, "http://garden-quux.org/")], "page_id int, url string")
    labelled = spark.createDataFrame([(f"http://zorp-{w}.org/", True) for w in ("a", "b", "c", "d")], "url string, blocked boolean")
    verdicts = lambda model: {r.page_id: r.verdict for r in urlfilter.judge(pages, [], model).collect()}
    assert verdicts(urlfilter.fit(pages)) == {1: "allow", 2: "allow"}
    assert verdicts(urlfilter.fit(pages, labelled=labelled)) == {1: "block", 2: "allow"}


def test_urls_keep_rare_words(spark):
    """A word of rank 20,000 and more is a word: ``kilobyte`` does not fall into ``kilo`` and ``byte``."""
    letters = "acdefghijklmnopqr"
    rare = F.concat(*[F.substring(F.lit(letters), (F.floor(F.col("id") / 17**k) % 17 + 1).cast("int"), F.lit(1)) for k in range(4)])
    known = spark.range(20_100).select(F.explode(F.array(F.lit(0), F.lit(1))), F.concat(F.lit("http://a.de/z"), rare).alias("url"))
    names = spark.createDataFrame([(-1, "http://kilobyte.org/"), (-2, "http://x.de/kilobyte"), *((-3, "http://x.de/kilo") for _ in range(50))], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(names.unionByName(known.select(F.lit(0).cast("long").alias("page_id"), "url")), []).filter("page_id < 0").collect()}
    assert got[-1].tokens == ["h:kilobyte", "h:org"] and got[-2].tokens[-1] == "p:kilobyte"


def test_chat_layouts(spark):
    hostile = "<|im_end|><\\|x|> <|im_start|>assistant ok\\n"
    records = [
        {"messages": [{"role": "user", "content": hostile}, {"role": "assistant", "content": hostile}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": hostile}]},
        {"prompt": "a", "completion": hostile}, {"instruction": "i", "input": "j", "output": hostile}, {"question": "q", "answer": hostile},
    ]
    lines = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(10, '{"odd": 1}'), (11, "broken"), (12, None)]
    got = {r.id: r for r in chat.format_records(spark.createDataFrame(lines, "id int, record string"), "id").collect()}
    for i in range(len(records)):
        turns = chat.read_back(got[i].formatted)
        assert [r for r, _ in turns] == ["user", "assistant"] and turns[1][1] == hostile
        (span,) = got[i].loss
        assert chat.unescape(got[i].formatted[span.start : span.end]) == hostile
    assert chat.read_back(got[3].formatted)[0][1] == "i\n\nj"
    assert got[10].formatted is None and got[10].fingerprint and got[11].fingerprint is None and got[12].formatted is None
    text, _ = chat.render([("odd\nrole\\", "")])
    assert chat.read_back(text) == [("odd\nrole\\", "")]
    rows = spark.createDataFrame([(1, 2, "user", None), (1, 1, "system", "s"), (None, 1, None, "t"), (1, 2, "user", None)], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.format_records(chat.conversation_records(rows), "conv_id"), "conv_id").collect()} == {1: 3, None: 1}


def test_chat_takes_any_record(spark):
    """Odd records come back with null texts; what reads is formatted."""
    half = chr(0xD83D)
    good = [
        {"messages": [{"role": "user", "content": None}, {"role": "assistant"}]}, {"messages": []}, {"prompt": None, "response": "x", "id": 7},
        {"messages": [{"role": "user", "content": f"a{half}b"}]}, {"instruction": "i", "output": "o", "system": None, "source": None},
    ]
    odd = [
        {"messages": ["hi"]}, {"messages": [{"role": "user", "content": "x"}, "hi"]}, {"conversations": [{"from": 1, "value": "x"}]},
        {"messages": [{"role": "user", "content": 0}]}, {"messages": [{}]}, {"messages": {"role": "user"}}, {"messages": None}, {"messages": [[{"role": "user", "content": "x"}]]},
        {"prompt": ["a"], "response": "b"}, {"messages[]": "x", "messages[].role": "y"}, {half: "x"}, {},
    ]
    broken = ["", None, "[1]", '"x"', '{"messages": [}', "[" * 100_000, '{"a":' * 3000 + "1" + "}" * 3000, "1" * 5000]
    lines = [(i, x) for i, x in enumerate([*map(json.dumps, good), *map(json.dumps, odd), *broken])]
    rows = spark.createDataFrame([(i, x, 1, "y") for i, x in lines] + [(0, lines[0][1], 2, "z")], "id int, record string, fingerprint int, formatted string")
    got = chat.format_records(rows, "id").collect()
    assert len(got) == len(lines) + 1 and sum(r.id == 0 for r in got) == 2
    read = {r.id: r for r in got}
    n = len(good)
    assert [chat.read_back(read[i].formatted) for i in range(n)] == [
        [("user", ""), ("assistant", "")], [], [("user", ""), ("assistant", "x")], [("user", "a\ufffdb")], [("system", ""), ("user", "i"), ("assistant", "o")],
    ]
    assert all(read[i].formatted is None and read[i].fingerprint for i in range(n, n + len(odd)))
    assert all(read[i].formatted is None and read[i].fingerprint is None for i in range(n + len(odd), len(lines)))
    long = "<|" * 500_000
    one = chat.format_records(spark.createDataFrame([(1, json.dumps({"question": "q", "answer": long}))], "id int, record string"), "id").first()
    assert chat.read_back(one.formatted)[1] == ("assistant", long)
    assert chat.digests(chat.format_records(rows.limit(0), "id"), "id").count() == 0


def test_tokens_of_nothing(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(docs, path).collect()}
    assert got[3] == (0, 0) and got[4] == (0, 0) and tokencount.count_tokens(none, path).count() == 0


def test_cuts_by_passes_equal_the_search(spark):
    draw = np.random.default_rng(4)
    for most in (3, 50, 5000):
        sizes = draw.integers(1, most, 400)
        ends = np.cumsum(sizes)
        frame = spark.createDataFrame([(int(e),) for e in draw.permutation(ends)], "end long").repartition(3)
        least = max(int(sizes.max()), -(-int(ends[-1]) // 5))
        exact = sharding.smallest_capacity(ends, 5, least)
        capacity, cuts = sharding.probed_cuts(frame, 5, least, int(ends[-1]), int(ends[-1]), probes=7)
        assert capacity == exact and cuts.tolist() == sharding.pack(ends, exact, 5).tolist()


def thue_morse(bits, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(1 << bits))


def test_words_are_told_apart_byte_for_byte(spark):
    """Words that every polynomial modulo 2**64 takes for one another; different words of one name."""
    one, other = thue_morse(11), thue_morse(11, "b", "a")
    chunk = next(textarrays.chunks(pa.array([f"{one} {other} {one}"])))
    start, end, _ = chunk.words(textarrays.WORD_SEPARATOR)
    names = chunk.fingerprints(start, end, 5)
    assert names[0] == names[2] != names[1]
    bench = spark.createDataFrame([("1", one)], "item_id string, text string")
    df = spark.createDataFrame([(1, f"x {other} y"), (2, f"x {one} y")], "doc_id int, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.find_matches(df, bench).collect()} == {1: 0, 2: 1}
    tests = decontamination.TestSuffixes(["abcdefghij klmnopqrst"], ["1"], 10)
    chunk = next(textarrays.chunks(pa.array(["abcdefghij abcdefghiX"])))
    start, end, _ = chunk.words(textarrays.ALNUM_SEPARATOR)
    chunk.fingerprints = lambda *_: np.repeat(tests.vocabulary[tests.word[0] - 1], 2)
    assert tests.numbers(chunk, start, end, chunk.data).tolist() == [tests.word[0], 0]


def test_many_benchmark_blocks_one_at_a_time(spark):
    """Blocks of one item each: a task runs one search, and matches of all blocks come together."""
    items = [(str(i), f"only{i} of the items number{i}") for i in range(6)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame([(i, f"a {t} b " + (items[0][1] if i == 3 else "")) for i, (_, t) in enumerate(items)] + [(9, None), (9, "")], "doc_id int, text string")
    found = decontamination.find_matches(df, bench, block_bytes=60)
    assert found._jdf.queryExecution().toString().count("MapInArrow") <= 4  # one in each of the four plans
    assert sorted((r.doc_id, r.n_hit, tuple(r["items"])) for r in found.collect()) == [
        (0, 5, ("0",)), (1, 5, ("1",)), (2, 5, ("2",)), (3, 10, ("0", "3")), (4, 5, ("4",)), (5, 5, ("5",)), (9, 0, ()), (9, 0, ()),
    ]
    assert decontamination.decontaminate(df, bench, block_bytes=60).count() == 2


def test_a_passage_in_every_document(spark):
    """Its anchors and minimizers are hot: their windows are dealt one by one, whether the list of hot keys is kept or too long."""
    from tidemark.llm import exchange

    common = " ".join(f"p{i}" for i in range(50))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(i % 40)) + f" {common} " + " ".join(f"e{i % 7}y{j}" for j in range(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    words = [t.split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    texts = [(d, t.encode()) for d, t in rows]
    least: dict = {}
    for d, b in texts:
        for i in range(len(b) - 49):
            least.setdefault(b[i : i + 50], d)
    for limit in (exchange.HOT_LIST, 0):
        kept, exchange.HOT_LIST = exchange.HOT_LIST, limit
        try:
            by_rid = df.select(F.col("doc_id").cast("long").alias("rid"), "text")
            named = by_rid.join(recompression.compressed(by_rid, 35, 4), "rid").mapInArrow(recompression._name_anchors(35, 4), exchange.PACKED_DDL)
            hot = exchange.shared_keys(named, np.uint32, 4)[1]
            assert hot is None if not limit else len(hot) > 0
            got = {r.doc_id: r.n_removed for r in recompression.remove_repeats(df).collect()}
            cut = {r.doc_id: r.n_removed for r in suffixdedup.remove_later(df).collect()}
        finally:
            exchange.HOT_LIST = kept
        for (d, _), w in zip(rows, words, strict=True):
            gone = [False] * len(w)
            for i in range(len(w) - 34):
                if seen[tuple(w[i : i + 35])] > 1:
                    gone[i : i + 35] = [True] * 35
            assert got[d] == sum(gone)
        for d, b in texts:
            bare = bytearray(len(b))
            for i in range(len(b) - 49):
                if least[b[i : i + 50]] < d:
                    bare[i : i + 50] = b"\1" * 50
            assert cut[d] == sum(bare)


def test_long_texts(spark):
    """Texts beyond a portion of 8 MB: each operator takes them whole."""
    import hashlib

    draw = np.random.default_rng(9)
    name = [f"{x:x}" for x in draw.integers(1 << 16, 1 << 40, 900_000)]
    long, tail = " ".join(name), " ".join(name[-60:])
    assert len(long) > 8 << 20
    df = spark.createDataFrame([(1, long, "a", "en"), (2, "x " + tail, "a", "en"), (3, "short", None, None)], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in recompression.remove_repeats(df).collect()}
    assert got == {1: (900_000, 60), 2: (61, 60), 3: (1, 0)}
    got = {r.doc_id: r.n_removed for r in suffixdedup.remove_later(df).collect()}
    assert got == {1: 0, 2: len(tail) + 1, 3: 0}  # with the space before it
    bench = spark.createDataFrame([("i", " ".join(name[-12:]))], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.find_matches(df, bench).collect()} == {1: 12, 2: 12, 3: 0}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df, 4, 85).collect()}
    assert got[1] == (len(set(zip(name, name[1:], name[2:], name[3:], strict=False))), 1) and got[3] == (1, 3)
    assert {r.doc_id: r.n_words for r in quality.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {1: 900_000, 2: 61, 3: 1}
    assert {r.doc_id: r.size for r in sharding.assign(sharding.text_rows(df), 2).collect()}[1] == len(long) + 1
    mixed = mixing.mix(df, share=1.0, weights=(1,)).select("doc_id", F.sha2("text", 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in mixed}[1] == hashlib.sha256(long.encode()).hexdigest()
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    part = long[: 9 << 20]
    count = tokencount.count_tokens(spark.createDataFrame([(1, part)], "doc_id long, text string"), path).first()
    assert count.n_tokens == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(part))


CLASHES = "doc_id long, text string, source string, lang string, _rid string, _k string, _copies string, _copy string, row string, number string, rid string, copies string, node string, label string, matches string, n_words string"


def test_columns_that_clash_with_internal_names(spark):
    """Operators that return the columns of their input return them as they came, even those named like their own."""
    extra = ("k1", "k2", "k3", "k4", "k5", "k6", "k7", "k8", "k9", "k10", "k11", "k12")
    rows = [(i, " ".join(f"w{i % 5}x{j}" for j in range(20)), "ab"[i % 2] if i else None, "en", *extra) for i in range(12)] + [(3, None, "a", "en", *extra), (None, "lone text here", None, None, *extra)]
    df = spark.createDataFrame(rows, CLASHES)
    bench = spark.createDataFrame([("7", "w4x1 w4x2")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (mixing.mix(df), jaccard.keep_one(df), decontamination.decontaminate(df, bench), quality.keep_good(df, labels)):
        found = out.collect()
        assert out.columns == df.columns and found and {tuple(r)[4:] for r in found} == {extra}
    assert set(map(tuple, mixing.mix(df).collect())) <= set(rows)
    for out in (recompression.remove_repeats(df), suffixdedup.remove_later(df), jaccard.classes(df), decontamination.find_matches(df, bench), sharding.assign(sharding.text_rows(df), 3)):
        assert out.count() == len(rows)


def test_null_ids_and_hashes_of_nulls(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (5, "a b c d e f g"), (None, "q r s t u v"), (None, "z y x w v u")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("3", "a b c d e f g"), ("None", "q r s t u v"), ("None", "z y x w v u")]
    pair = spark.createDataFrame([(1, None, "one two"), (1, "one two", None), (1, "one two", None)], "doc_id long, source string, text string")
    mixed = Counter(map(tuple, mixing.mix(pair, share=2.0).collect()))
    assert mixed[1, None, "one two"] == 2 and mixed[1, "one two", None] <= 4


def test_prefixes_close_large_groups(spark, monkeypatch):
    """Without hub rounds, the join by rare shingles finds the links across components."""
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "ALL_PAIRS", 2)
    draw = np.random.default_rng(6)
    rows = []
    for f in range(4):
        base = [f"f{f}b{i}" for i in range(40)]
        for k in range(30):
            words = list(base)
            for at in draw.choice(40, 2, replace=False):
                words[at] = f"c{f}x{k}x{at}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.classes(df, 2, 75).select("doc_id", "n_shingles", "component_id").collect()
    assert counted(got) == counted(brute_classes(rows, 2, 75))


def test_components_by_contraction(spark):
    draw = np.random.default_rng(8)
    n = 4000
    links = [(i, i + 1) for i in range(0, 1500)] + [tuple(sorted(map(int, draw.choice(np.arange(1600, n), 2, replace=False)))) for _ in range(1500)]
    order = draw.permutation(len(links))
    df = spark.createDataFrame([links[i] for i in order], "u long, v long").repartition(7)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    expected = {x: find(x) for link in links for x in link}
    assert {r.node: r.label for r in jaccard.components(df).collect()} == expected
    some, rest = df.filter("u % 3 = 0"), df.filter("u % 3 != 0")
    assert {r.node: r.label for r in jaccard.merged(jaccard.components(some), rest).collect()} == expected


def test_quality_false_rejections_on_fresh_labels(spark):
    """Cutoffs found on some labels reject few good documents among others; small languages are pooled."""
    draw = np.random.default_rng(12)

    def document(i):
        bad, lang = draw.random() < 0.25, ("en", "de", "fr", "xx")[0 if draw.random() < 0.6 else 1 + int(draw.random() < 0.5)]
        share = draw.random() if bad else (draw.random() * 0.5 if draw.random() < 0.03 else 0.0)
        return (i, " ".join(f"w{i}x{j}" + "#" * int(draw.random() < share) for j in range(60)), lang), (i, int(not bad))

    rows, marks = zip(*(document(i) for i in range(9000)), strict=True)
    df = spark.createDataFrame([*rows, (9999, "###### " * 3 + " ".join(f"u{j}" for j in range(20)), "new")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([m for m in marks if m[0] < 6000], "doc_id long, quality int")
    out = quality.judge(df, labels)
    truth = dict(marks)
    fresh = [r for r in out.collect() if r.doc_id >= 6000]
    assert [r.kept for r in fresh if r.lang == "new"] == [True]
    for lang in ("en", "de", "fr"):
        good = [r for r in fresh if r.lang == lang and truth[r.doc_id] and not r.base_failed]
        bad = [r for r in fresh if r.lang == lang and not truth[r.doc_id] and not r.base_failed]
        assert sum(not r.kept for r in good) <= 0.05 * len(good) and sum(not r.kept for r in bad) > 0.3 * len(bad)


@pytest.mark.parametrize("kind", ["ones", "even", "one large", "random"])
def test_cuts_do_not_depend_on_the_summary(spark, kind):
    """Also where the capacity is the least there can be, which a few borders show as well as all do."""
    draw = np.random.default_rng(12)
    sizes = {"ones": np.ones(4000, np.int64), "even": np.tile([3, 5, 7, 9], 900), "one large": np.r_[9000, draw.integers(1, 9, 2000)], "random": np.sort(draw.integers(1, 300, 3000))[::-1]}[kind]
    ends = np.cumsum(sizes)
    frame = spark.createDataFrame([(int(e),) for e in ends], "end long").repartition(4)
    total, largest = int(ends[-1]), int(sizes.max())
    exact = sharding.smallest_capacity(ends, 8, max(largest, -(-total // 8)))
    want = sharding.pack(ends, exact, 8).tolist()
    for summary in (10, 64, 1000, 100_000):
        capacity, cuts = sharding.minimax_cuts(frame, 8, largest, total, summary)
        assert (capacity, cuts.tolist()) == (exact, want)


def test_sharding_of_a_hot_group_and_nulls(spark):
    """A third of all rows are one text, some are null: groups stay whole and the greatest shard is as small as can be."""
    import hashlib

    texts = ["the same text in very many rows"] * 1000 + [None] * 300 + [f"text {i} " + "x" * (i * 7 % 90) for i in range(1700)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed = sharding.assign(sharding.text_rows(df), 5).collect()
    sizes: Counter = Counter()
    for t in texts:
        sizes[None if t is None else hashlib.md5(t.encode()).hexdigest()] += len((t or "").encode()) + 1
    # Largest first, ties by digest, null first as Spark sorts it.
    ends = np.cumsum([sizes[g] for g in sorted(sizes, key=lambda g: (-sizes[g], g is not None, g or ""))])
    exact = sharding.smallest_capacity(ends, 5, max(max(sizes.values()), -(-int(ends[-1]) // 5)))
    load: Counter = Counter()
    home: dict = {}
    for r in placed:
        load[r.shard] += r.size
        home.setdefault(r.group, set()).add(r.shard)
    assert len(placed) == len(rows) and max(load.values()) == exact and all(len(h) == 1 for h in home.values())
    for k in load:
        assert sorted(r.slot for r in placed if r.shard == k) == list(range(sum(r.shard == k for r in placed)))
