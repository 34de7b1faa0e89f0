"""Spelling variants, hard negatives and audio columns against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import io
import math
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audio, hardneg, queries, variants

# Spelling variants.

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def grouped(counts: dict[str, int]) -> list[tuple]:
    """Every pair compared; forms followed one by one."""
    form, near = {}, {}
    for w in counts:
        found = [x for x in counts if one_edit(w, x)]
        near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, near[w], counts.get(form[w])) for w, n in counts.items())


def _group(spark, counts, **settings):
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(map(tuple, variants.group(rows, **settings).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("settings", [{}, {"trie_words": 16, "block_bytes": 1}], ids=["one block", "many blocks"])
def test_variants_equal_brute_force(spark, settings):
    draw = np.random.default_rng(3)
    words = {"".join(draw.choice(list("abé"), draw.integers(1, 7))) for _ in range(300)}
    counts = {w: int(draw.integers(1, 60)) for w in sorted(words)}
    assert _group(spark, counts, **settings) == grouped(counts)


def test_variants_follow_chains_and_break_ties(spark):
    counts = {"aaaaa": 1000, "aaaab": 400, "aaabb": 100, "aabbb": 40, "abbbb": 10, "bbbbb": 4, "zzzzz": 8, "zzzzy": 16, "zzzzx": 16, "lonely": 5, "": 3, "q": 9}
    got = _group(spark, counts)
    assert got == grouped(counts)
    assert {r[0]: r[2] for r in got}["bbbbb"] == "aaaaa" and {r[0]: r[1] for r in got}["zzzzz"] == "zzzzx"


def test_variants_of_long_and_periodic_words(spark):
    counts = {"a" * 3000: 9, "a" * 2999: 3, "ab" * 1500: 7, "ab" * 1500 + "a": 20, "b" + "ab" * 1500: 2}
    assert _group(spark, counts) == grouped(counts)


def test_variants_trie_is_exact():
    words = sorted({"", "a", "ab", "abc", "b", "ba", "é", "éa"})
    trie = variants.build_trie(words, [7] * len(words))
    for w in [*words, "xab", "abcd", "aé"]:
        assert sorted(variants.near_words(w, trie).values()) == [x for x in words if one_edit(w, x)]
    assert variants.near_words("a", variants.build_trie([], [])) == {}


DOCS = "doc_id long, text string, word string, n long, form string, root long, run string"


def test_variants_query_rows(spark, tmp_path):
    """Runs, crc32 and counts in plain Python; nulls, repeats, clashing columns, upper case."""
    texts = ["Éclair ÉCLAIR éclair eclair", None, "", "stone store stone stone 12 stones STONE", "x" * 5000 + " straße×straße÷straße", "stone store stone stone 12 stones STONE"]
    rows = [(i if i != 3 else None, t, "w", 1, "f", 2, "r") for i, t in enumerate(texts * 40)] + [(7, texts[0], "w", 1, "f", 2, "r")] * 3
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    counts: Counter = Counter()
    for d, t, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = queries.op11_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == grouped(kept)
    none = spark.createDataFrame([], DOCS)
    assert variants.group(variants.count(variants.runs(none).withColumnRenamed("run", "word"))).count() == 0


# Hard negatives.


def mined(rows: list[tuple], positives=5, negatives=5) -> list[tuple]:
    """(vec_id, label, vector) of all pairs, in whole numbers."""
    usable = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        if i not in usable or (label, whole) < usable[i]:
            usable[i] = (label, whole)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in usable.items():
        if a % 10:
            continue
        scored = sorted((-dot(v, w), i, other) for i, (other, w) in usable.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, r, i, -s, -x) for r, (x, i, _) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, cell int, grp int, part int, d double, score long, n long"


def _mine(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, 2, 3, 0.5, 4, 5) for r in rows], VECTORS)
    got = hardneg.mine(hardneg.usable(df), F.col("vec_id") % 10 == 0, **settings)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def _vectors(seed, n, dim=6, labels=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dim))
    return [(i, int(draw.integers(labels)), [float(np.float32(x)) for x in centres[draw.integers(labels)] + 0.4 * draw.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"pivots": 7, "group_anchors": 3, "part_rows": 20}, {"pivots": 1}], ids=["usual", "many groups", "one pivot"])
def test_negatives_equal_brute_force(spark, settings):
    rows = _vectors(5, 300)
    assert _mine(spark, rows, **settings) == mined(rows)


def test_negatives_of_copies_nulls_and_odd_vectors(spark):
    """A third of all rows is one vector; nulls, infinities, repeated ids, zeros and short vectors."""
    rows = _vectors(6, 150, 4)
    copy = [0.5, 0.25, -0.5, 1.0]
    rows += [(i, i % 3, copy) for i in range(150, 230)]
    rows += [(300, None, copy), (None, 1, copy), (301, 1, None), (302, 1, [1.0, None, 0.0, 0.0]), (303, 1, [float("inf"), 0.0, 0.0, 0.0]), (304, 2, [float("nan")] * 4)]
    rows += [(160, 0, copy), (160, 2, [9.0, 0.0, 0.0, 0.0]), (310, 0, [0.0] * 4), (320, 1, []), (321, 1, [1.0]), (330, 0, [0.0] * 4)]
    assert _mine(spark, rows, pivots=5, group_anchors=4, part_rows=32) == mined(rows)


def test_negatives_of_empty_and_lonely_tables(spark):
    assert _mine(spark, []) == []
    assert _mine(spark, [(0, 1, [1.0, 2.0])]) == []
    assert _mine(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, None, None)]) == mined([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])])
    assert _mine(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


def test_negatives_of_huge_components(spark):
    """Beyond what doubles hold exactly, scores are still whole numbers."""
    rows = [(i, i % 2, [float(2**19 + i), float(3 * i - 40)]) for i in range(60)]
    assert _mine(spark, rows) == mined(rows)
    _mine(spark, [*rows, (70, 1, [3e38, 1.0])])


def test_bounds_rule_cells_out(spark):
    """Well-separated clusters: rows are copied to fewer groups than there are."""
    draw = np.random.default_rng(8)
    rows = [(i, i % 8, [float(20 * (i % 8 == j)) + float(draw.normal() * 0.05) for j in range(8)]) for i in range(800)]
    df = hardneg.usable(spark.createDataFrame([(*r, 1, 2, 3, 0.5, 4, 5) for r in rows], VECTORS))
    space = hardneg._space(df)
    pivots = hardneg.pick_pivots(df, space, 32)
    placed = hardneg.assigned(df, pivots, space)
    anchors = hardneg.assigned(df.filter("vec_id % 10 = 0"), pivots, space, True)
    windows = anchors.select(F.col("label").cast("int").alias("grp"), "v", F.lit(0.0).alias("near"), F.lit(0.5).alias("far"))
    copies = hardneg._copied(placed, hardneg.reach(windows, pivots, space)).count()
    assert copies == len(rows) // 2  # four of the eight clusters have anchors


# Audio.


def slow_features(payload: bytes):
    """Zero-stuffing and a whole convolution, a sum for each Fourier bin's power, a loop over states."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    half, cut = audio.REACH * audio.UP, 1 / 3
    t = np.arange(-half, half + 1)
    h = audio.UP * cut * np.sinc(t * cut) * (0.5 + 0.5 * np.cos(np.pi * t / (half + 1)))
    dense = np.zeros(len(x) * audio.UP)
    dense[:: audio.UP] = x
    y = np.convolve(dense, h)[half : half + len(dense)][:: audio.DOWN]
    frames = 1 if len(y) <= 400 else 1 + math.ceil((len(y) - 400) / 160)
    y = np.r_[y, np.zeros(frames * 160 + 400)]
    n = np.arange(400)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / 400)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(257), n) / 512)
    mels, energy = [], []
    for f in range(frames):
        piece = y[160 * f : 160 * f + 400]
        power = np.abs(turn @ (piece * window)) ** 2 / 512
        mels.append(np.log(power @ audio.filterbank() + 1e-6))
        energy.append(10 * math.log10(np.mean(piece**2) + 1e-6))
    level, on, spans = np.mean(energy), False, []
    for f, e in enumerate([*energy, -np.inf]):
        if not on and e >= level + audio.OPENS:
            on, begin = True, f
        elif on and e < level - audio.CLOSES:
            on = False
            spans.append((begin * 10, (f - 1) * 10 + 25))
    return np.array(mels), spans


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 700, 5000])
def test_features_equal_a_slow_version(n, monkeypatch):
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    text = bytes(np.random.default_rng(n).integers(32, 127, n, dtype=np.uint8))
    text = text[: n // 2] + b" " * (n // 4) + text[n // 2 + n // 4 :]
    payload = audio.padded(text)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(text)
    stream, spans, frames, mean = audio._packed(payload)
    table = audio.read_tensors(stream)
    mel = np.concatenate([c.to_numpy_ndarray().reshape(-1, audio.BANDS) for c in table["logmel"].chunks]) if table.num_rows else None
    slow, slow_spans = slow_features(payload)
    used = np.concatenate([mel[i * 100 : i * 100 + k] for i, k in enumerate(table["n_frames"].to_pylist())])
    assert used.shape == slow.shape == (frames, 40) and np.allclose(used, slow, atol=2e-3)
    assert mean == pytest.approx(slow.mean(), abs=1e-3) and [tuple(s) for s in spans.tolist()] == slow_spans
    assert table["start_ms"].to_pylist()[0] == 0 and table["end_ms"].to_pylist()[-1] == (frames - 1) * 10 + 25


def test_blocks_do_not_show(monkeypatch):
    payload = audio.padded(b"The wave came in, and then it went. " * 900)
    whole = audio._packed(payload)
    monkeypatch.setattr(audio, "BLOCK_FRAMES", audio.TENSOR_FRAMES)
    parts = audio._packed(payload)
    assert (whole[1] == parts[1]).all() and whole[2] == parts[2]
    a, b = (np.concatenate([c.to_numpy_ndarray() for c in audio.read_tensors(x[0])["logmel"].chunks]) for x in (whole, parts))
    assert np.allclose(a, b, atol=1e-4)


def test_media_query_reads_back_with_another_reader(spark, small):
    texts = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    media = {r.doc_id: bytes(r.media) for r in audio.store(queries.table(spark, small, "documents")).collect()}
    got = queries.op13_media(spark, small).collect()
    assert len(got) == len(texts)
    by_text: dict = {}
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        with wave.open(io.BytesIO(media[r.doc_id])) as file:
            assert (file.getnchannels(), file.getsampwidth(), file.getframerate()) == (1, 1, audio.RATE)
            payload = file.readframes(file.getnframes())
        assert payload == data + b" " * (len(payload) - len(data)) and 0 < len(payload) < len(data) + 193
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(data), len(payload), len(media[r.doc_id]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert by_text.setdefault(texts[r.doc_id], r.feature) == r.feature
    assert len(set(by_text.values())) > len(by_text) // 2


def test_media_edges(spark):
    kind = "doc_id long, text string, media string, payload int, n_frames string, tensors int"
    rows = [(1, None), (2, ""), (None, "a"), (3, "é" * 200_000), (3, "é" * 200_000), (4, "\x00")]
    made = audio.features(audio.store(spark.createDataFrame([(*r, "m", 1, "x", 2) for r in rows], kind)))
    got = [(r.doc_id, r.n_bytes, len(r.payload), r.n_frames, bytes(r.tensors)) for r in made.collect()]
    assert sorted(x[:3] for x in got if x[0] is not None) == [(1, 0, 192), (2, 0, 192), (3, 400_000, 400_128), (3, 400_000, 400_128), (4, 1, 192)]
    assert len({x[4] for x in got if x[0] == 3}) == 1 and len({x[4] for x in got if x[0] in (1, 2)}) == 1
    tensors = audio.tensor_rows(made)
    assert tensors.filter("size(logmel) <> 4000").isEmpty() and tensors.agg(F.sum("n_frames")).first()[0] == sum(x[3] for x in got)
    broken = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"RIFF")), (3, 0, bytearray(audio.to_wav(b"x" * 192)[:100]))], "doc_id long, n_bytes long, media binary")
    assert audio.features(broken).filter("payload is not null or tensors is not null").isEmpty() and audio.features(broken).count() == 3
    assert audio.features(audio.store(spark.createDataFrame([], kind))).count() == 0


def test_wav_reader_skips_other_chunks():
    file = audio.to_wav(b"ab")
    extra = file[:12] + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + file[12:]
    assert audio.from_wav(extra) == b"ab"
    for bad in (b"", b"RIFF0000WAVE", file[:30], file.replace(b"fmt ", b"fmx ")):
        with pytest.raises(ValueError):
            audio.from_wav(bad)
