"""Benchmark decontamination with suffix arrays over the training words.

Each chunk of documents is a shard. Its suffix array orders the suffixes that can
match: those that begin with as many benchmark words as the shortest window with the
same first word asks for. Every test suffix is binary-searched in every shard; a hit
is extended to the longest verbatim match, whose place and length are returned.

The benchmark is read in blocks of ``BLOCK_BYTES`` of text at most (a longer item is a
block of its own), each shipped with one pass over the documents' ids and texts, of which
only the rows with matches are staged: no block copies the texts. The driver and a
task hold one block at a time, whatever the size of the benchmark.

Words: A-Z lower-cased, runs of bytes outside 00-2F, 3A-60, 7B-7F. Words are numbered by
fingerprint and then compared byte for byte, so different words never match. A null text
has no words. Items without words match nothing; an item of fewer words than the window is
one window. Items that share an id count once. Rows of ``docs`` are judged one by
one, repeated rows alike. Texts of any length are handled whole, by one task. An empty
table gives an empty result; an empty benchmark matches nothing. Extra columns are ignored
by ``find_matches`` and kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import broadcast_if_small, release, stage, with_rid
from .textarrays import ALNUM_SEPARATOR, LOWER, U, chunks, equal_slices, portions

BLOCK_BYTES = 8 << 20
WORD_SEED = 21
SHARD_BYTES = 4 << 20
LAST = np.uint32(0xFFFFFFFF)


class TestSuffixes:
    """A block of benchmark items: vocabulary, word numbers, windows as search keys."""

    def __init__(self, texts: list[str | None], ids: list[str], width: int):
        chunk = next(chunks(pa.array(texts, pa.large_string()), 1 << 40), None)
        self.width, self.ids, self.seed = width, ids, WORD_SEED
        if chunk is None:
            self.data, row, words = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, U)
            start = end = row
        else:
            self.data = LOWER[chunk.data]
            start, end, row = chunk.words(ALNUM_SEPARATOR, self.data)
            words = chunk.fingerprints(start, end, self.seed, self.data)
        while True:
            self.vocabulary, first, number = np.unique(words, return_index=True, return_inverse=True)
            self.place, self.length = start[first], end[first] - start[first]
            if self._same(number, self.data, start, end).all():
                break
            self.seed += 1  # two words of one name: name all anew
            words = chunk.fingerprints(start, end, self.seed, self.data)
        self.word = (number + 1).astype(np.uint32)
        self.row = row
        n = len(words)
        self.begin = np.searchsorted(row, row, "left")
        self.end = np.searchsorted(row, row, "right")
        at = np.arange(n)
        length = self.end - at
        self.start = np.flatnonzero((length >= width) | (at == self.begin))
        self.size = np.minimum(length[self.start], width)
        self.low = self._keys(0)
        self.high = self._keys(LAST)
        self.need = np.full(len(self.vocabulary) + 1, 1 << 40, np.int64)
        np.minimum.at(self.need, self.word[self.start], self.size)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocabulary & U(0xFFFF)).astype(np.int64)] = True

    def _keys(self, fill: int) -> np.ndarray:
        place = self.start[:, None] + np.arange(self.width)
        inside = np.arange(self.width) < self.size[:, None]
        key = np.where(inside, self.word[np.minimum(place, max(0, len(self.word) - 1))] if len(self.word) else 0, fill)
        return search_keys(key.astype(np.uint32))

    def _same(self, number, data, start, end) -> np.ndarray:
        """Is each word of ``data`` the word of the vocabulary with that number, byte for byte?"""
        same = self.length[number] == end - start
        long = np.flatnonzero(same & (end - start > 8))  # names are one-to-one on shorter words of one length
        same[long] = equal_slices(self.data, self.place[number[long]], data, start[long], (end - start)[long])
        return same

    def numbers(self, chunk, start, end, data) -> np.ndarray:
        """Vocabulary number of each word, from 1 on; 0 for words that no item has."""
        words = chunk.fingerprints(start, end, self.seed, data)
        out = np.zeros(len(words), np.uint32)
        ask = np.flatnonzero(self.sieve[(words & U(0xFFFF)).astype(np.int64)])
        if len(ask) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, words[ask]), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == words[ask]
            ask, at = ask[known], at[known]
            same = self._same(at, data, start[ask], end[ask])
            out[ask[same]] = at[same] + 1
        return out


@dataclass(frozen=True)
class Block:
    """Texts and ids of some benchmark items, as they travel; a worker process makes the tables of the last block it met."""

    name: str
    texts: list[str | None]
    ids: list[str]
    width: int

    def tests(self) -> TestSuffixes:
        if self.name not in _made:
            _made.clear()
            _made[self.name] = TestSuffixes(self.texts, self.ids, self.width)
        return _made[self.name]


_made: dict[str, TestSuffixes] = {}


def search_keys(numbers: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order."""
    n, width = numbers.shape
    return np.ascontiguousarray(numbers.astype(">u4")).view(f"S{4 * width}").reshape(n) if n else np.zeros(0, f"S{4 * width}")


def search(number: np.ndarray, row: np.ndarray, tests: TestSuffixes):
    """Longest matches of the test suffixes in one shard of numbered words: starts, lengths, item rows."""
    n, width = len(number), tests.width
    none = np.zeros(0, np.int64)
    if not n or not len(tests.start):
        return none, none, none
    edge = np.r_[np.flatnonzero(row[1:] != row[:-1]) + 1, n]
    stop = np.where(number == 0, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    row_end = edge[np.searchsorted(edge, np.arange(n), "right")]
    stop = np.minimum(stop, row_end)
    able = np.flatnonzero(stop - np.arange(n) >= tests.need[number])
    if not len(able):
        return none, none, none
    place = able[:, None] + np.arange(width)
    key = np.where(place < stop[able][:, None], number[np.minimum(place, n - 1)], 0)
    key = search_keys(key.astype(np.uint32))
    suffix = np.argsort(key, kind="stable")
    key, able = key[suffix], able[suffix]
    low = np.searchsorted(key, tests.low, "left")
    high = np.searchsorted(key, tests.high, "right")
    hits = np.maximum(high - low, 0)
    test = np.repeat(np.arange(len(hits)), hits)
    if not len(test):
        return none, none, none
    at = able[np.repeat(low, hits) + np.arange(len(test)) - np.repeat(np.cumsum(hits) - hits, hits)]
    begin = tests.start[test]
    row_begin = np.r_[0, edge[:-1]][np.searchsorted(edge, at, "right")]
    grows = (at > row_begin) & (begin > tests.begin[begin])
    grows &= number[at - 1] == tests.word[begin - 1]
    grows &= tests.size[test] == width
    at, begin, test = at[~grows], begin[~grows], test[~grows]
    length = tests.size[test].copy()
    going = np.arange(len(at))
    while len(going):
        i, j = at[going] + length[going], begin[going] + length[going]
        on = (i < stop[at[going]]) & (j < tests.end[begin[going]])
        on[on] = number[i[on]] == tests.word[j[on]]
        going = going[on]
        length[going] += 1
    return at, length, tests.row[begin]


MATCHES = "array<struct<start: long, length: long, item: string>>"


def _search_block(block: Block, hits_only: bool):
    """Adds n_words and matches, without the text. hits_only: (rid, matches) of the rows that have some."""

    def run(batches):
        tests = block.tests()
        items = pa.array(tests.ids, pa.string())
        for batch in portions(batches):
            for chunk in chunks(batch.column("text"), SHARD_BYTES):
                data = LOWER[chunk.data]
                start, end, row = chunk.words(ALNUM_SEPARATOR, data)
                at, length, item = search(tests.numbers(chunk, start, end, data), row, tests)
                at_row = row[at] if len(at) else at
                order = np.lexsort((at, at_row))
                at, length, item, at_row = at[order], length[order], item[order], at_row[order]
                border = np.searchsorted(at_row, np.arange(chunk.rows + 1)).astype(np.int32)
                at = at - np.searchsorted(row, np.arange(chunk.rows))[at_row] if len(at) else at
                found = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(length, pa.int64()), items.take(pa.array(item, pa.int64()))], ["start", "length", "item"])
                part = batch.slice(chunk.lo, chunk.rows)
                lists = pa.ListArray.from_arrays(pa.array(border), found)
                if hits_only:
                    some = pa.array(np.diff(border) > 0)
                    yield pa.RecordBatch.from_arrays([part.column("rid").filter(some), lists.filter(some)], names=["rid", "matches"])
                    continue
                counts = pa.array(np.bincount(row, minlength=chunk.rows), pa.int64())
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), counts, lists], names=[*names, "n_words", "matches"])

    return run


def _blocks(benchmark: DataFrame, width: int, block_bytes: int):
    """The blocks one after the other: items in order of a hash, cut before one that would exceed ``block_bytes``."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 64), F.lit(0))).first()[0]
    keys = [F.xxhash64("item", "text"), "item", "text"]
    # A partition has about a block, and comes to the driver when its turn is there.
    rows = benchmark.repartitionByRange(int(1 + total // block_bytes), *keys).sortWithinPartitions(*keys)
    texts, ids, held = [], [], 0
    made = lambda: Block(uuid.uuid4().hex, texts, ids, width)
    for r in rows.toLocalIterator():
        size = len((r.text or "").encode()) + 64
        if ids and held + size > block_bytes:
            yield made()
            texts, ids, held = [], [], 0
        texts.append(r.text)
        ids.append(r.item)
        held += size
    yield made()


def _search_all(docs: DataFrame, benchmark: DataFrame, width: int, item_column: str, item_text: str, block_bytes: int) -> DataFrame:
    """``docs`` (rid, text and others) with n_words and matches, without text; staged."""
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words long", f"matches {MATCHES}"])
    first, more = None, []
    for block in _blocks(items, width, block_bytes):
        if first is None:
            first = stage(docs.mapInArrow(_search_block(block, False), schema))
        else:
            more.append(stage(docs.select("rid", "text").mapInArrow(_search_block(block, True), f"rid long, matches {MATCHES}")))
    if not more:
        return first
    # Rows of one name have one text: what each block found for them is the same.
    each = [m.groupBy("rid").agg(F.first("matches").alias("matches")) for m in more]
    found = reduce(DataFrame.unionAll, each).groupBy("rid").agg(F.flatten(F.collect_list("matches")).alias("_more"))
    joined = first.join(found, "rid", "left").withColumn("matches", F.concat("matches", F.coalesce("_more", F.array().cast(MATCHES))))
    out = stage(joined.select(*first.columns))
    release(first, *more)
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, matches (start, length, item) and items (sorted ids) of each row.

    matches are longest verbatim matches that hold a window of ``width`` words (or a
    whole shorter item); n_hit counts the words inside them.
    """
    named = with_rid(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    found = _search_all(named, benchmark, width, item_column, item_text, block_bytes).drop("rid")
    return found.withColumns({"n_hit": _hit_words("matches"), "items": F.array_sort(F.array_distinct("matches.item"))})


def _hit_words(matches: str):
    def add(seen, m):
        end = m["start"] + m["length"]
        new = F.greatest(F.lit(0), end - F.greatest(m["start"], seen["end"]))
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["n"] + new).alias("n"))

    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(matches), zero, add, lambda seen: seen["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs.

    The search stages names of rows only; the texts of what stays are read once more.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = with_rid(docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"), whole))
    found = _search_all(named.select("rid", "text"), benchmark, width, item_column, item_text, block_bytes)
    gone = broadcast_if_small(found.filter(F.size("matches") > 0).select("rid").distinct())
    release(found)
    return named.join(gone, "rid", "left_anti").select("row.*")
