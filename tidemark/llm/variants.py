"""Spelling variants: each word's near words and the form that outnumbers it.

Counted words are dealt by range into compact tries of bounded size (:class:`Trie`). Blocks
of tries are broadcast, ``BLOCK_BYTES`` at most; each word's distance-one Levenshtein
automaton is intersected with every trie depth-first (:func:`near_words`), and a task
reduces what it accepts to one row per word and block: the number of near words and the
best of them. More tries than a block holds cost one more scan of the words (not of the
texts) per block. Roots are found by pointer doubling, a join of pairs per round.

Null texts hold no words; a null id counts as an empty one. A run of any length is one
word; it is a trie of its own if it has more than ``TRIE_CHARS`` code points. Ties of n go
to the smaller word in code-point order. Repeated rows count each time. An empty table gives
an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import release, shuffle_width, stage
from .textarrays import give_back

#: Words and code points of a trie; bytes of the tries that are broadcast together.
TRIE_WORDS, TRIE_CHARS, BLOCK_BYTES = 1 << 18, 1 << 22, 48 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]+"


def runs(docs: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(doc_id, run): each maximal run of letters of each text, A-Z lower-cased, once per occurrence."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(letters), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def misspelt(run: Column, doc_id: Column, every: int) -> Column:
    """The run, one code point short where ``every`` divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count(words: DataFrame, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


class Trie(NamedTuple):
    """Nodes in breadth-first order. Edges ``first[v]`` to ``first[v + 1]`` leave node v; edge e has the code point ``labels[e]`` and leads to node e + 1. ``counts[v]`` is n of the word that ends in v, else 0."""

    labels: str
    first: array
    counts: array


def build_trie(words: list[str], counts: list[int]) -> Trie:
    """The trie of distinct words in code-point order."""
    labels, first, ends = [], array("i"), array("q")
    waiting = deque([(0, len(words), 0)])
    while waiting:
        lo, hi, depth = waiting.popleft()
        first.append(len(labels))
        ends.append(0)
        if lo < hi and len(words[lo]) == depth:
            ends[-1] = counts[lo]
            lo += 1
        while lo < hi:
            letter, end = words[lo][depth], lo + 1
            while end < hi and words[end][depth] == letter:
                end += 1
            labels.append(letter)
            waiting.append((lo, end, depth + 1))
            lo = end
    first.append(len(labels))
    return Trie("".join(labels), first, ends)


def near_words(word: str, trie: Trie) -> dict[int, str]:
    """The trie's words at distance one from ``word``, by end node.

    Depth-first: while the automaton has spent no edit it walks down the word's own path; at
    each node it branches into a deletion, an insertion or a replacement by each child, and
    what follows an edit has one way on. Of equal neighbouring letters only the first is
    deleted or doubled, as the others give the same words.
    """
    labels, first, counts = trie
    find, size, found = labels.find, len(word), {}

    def finish(v: int, i: int) -> int:
        """The node that the rest of the word leads to, if a word ends there; else -1."""
        while i < size:
            e = find(word[i], first[v], first[v + 1])
            if e < 0:
                return -1
            v, i = e + 1, i + 1
        return v if counts[v] else -1

    v, before = 0, ""
    for i in range(size + 1):
        letter = word[i] if i < size else ""
        if letter and letter != before and (end := finish(v, i + 1)) >= 0:
            found[end] = word[:i] + word[i + 1 :]
        on, after = -1, word[i + 1] if i + 1 < size else ""
        for e in range(first[v], first[v + 1]):
            c, child = labels[e], e + 1
            if c == letter:
                on = child
            elif letter:
                # A replacement: the next letter is looked up before the way on is taken.
                if not after:
                    if counts[child]:
                        found[child] = word[:i] + c
                elif find(after, first[child], first[child + 1]) >= 0 and (end := finish(child, i + 1)) >= 0:
                    found[end] = word[:i] + c + word[i + 1 :]
            if c != before and (not letter or find(letter, first[child], first[child + 1]) >= 0) and (end := finish(child, i)) >= 0:
                found[end] = word[:i] + c + word[i:]
        if on < 0:
            break
        v, before = on, letter
    return found


def _tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of the partition's words, which ascend."""
    words, counts, chars = [], [], 0

    def made() -> pa.RecordBatch:
        trie = build_trie(words, counts)
        return pa.RecordBatch.from_arrays([pa.array([trie.labels]), pa.array([trie.first.tobytes()], pa.binary()), pa.array([trie.counts.tobytes()], pa.binary())], names=["labels", "first", "counts"])

    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if words and (len(words) >= TRIE_WORDS or chars + len(word) > TRIE_CHARS):
                yield made()
                words, counts, chars = [], [], 0
            words.append(word)
            counts.append(n)
            chars += len(word)
    if words:
        yield made()
        words, counts = [], []
    give_back()


def tries(words: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """Staged (id, labels, first, counts, size): compact tries of ranges of the words (word, n)."""
    parts = 1 + 2 * words.count() // trie_words
    rows = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    made = rows.mapInArrow(_tries, "labels string, first binary, counts binary")
    size = F.octet_length("labels") + F.octet_length("first") + F.octet_length("counts")
    return stage(made.withColumns({"id": F.monotonically_increasing_id(), "size": size.cast("long")}))


def _blocks(shards: DataFrame, block_bytes: int) -> Iterator[list]:
    """The ids of the tries, in blocks of ``block_bytes`` or of one larger trie; only ids and sizes pass through here."""
    ids, held = [], 0
    for row in shards.select("id", "size").orderBy("id").toLocalIterator():
        if ids and held + row.size > block_bytes:
            yield ids
            ids, held = [], 0
        ids.append(row.id)
        held += row.size
    if ids:
        yield ids


def _array(kind: str, data: bytes) -> array:
    out = array(kind)
    out.frombytes(data)
    return out


_decoded: dict[str, list[Trie]] = {}


def _match(name: str, block):
    """Per word: its near words in the block's tries, their number, the n of the best and the best."""

    def run(batches):
        if name not in _decoded:
            _decoded.clear()
            _decoded[name] = [Trie(labels, _array("i", first), _array("q", counts)) for labels, first, counts in block.value]
        held = _decoded[name]
        for batch in batches:
            words, near, form_n, form = batch.column("word").to_pylist(), [], [], []
            for word in words:
                number, best = 0, (0, None)
                for trie in held:
                    found = near_words(word, trie)
                    number += len(found)
                    if found:
                        best = min(best, min((-trie.counts[v], w) for v, w in found.items()))
                near.append(number)
                form_n.append(-best[0])
                form.append(best[1])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(near, pa.int64()), pa.array(form_n, pa.int64()), pa.array(form, pa.string())], names=["word", "n_near", "form_n", "form"])

    return run


def neighbours(words: DataFrame, block_bytes: int = BLOCK_BYTES, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, n_near, form, form_n): the number of near words and the one of greatest n, null without any."""
    spark, shards = words.sparkSession, tries(words, trie_words)
    # Neighbouring words differ little in cost but whole ranges do: they are dealt by hash.
    dealt = words.select("word").repartition(max(shuffle_width(spark), 1), "word")
    parts = []
    for ids in _blocks(shards, block_bytes):
        held = [(r.labels, bytes(r.first), bytes(r.counts)) for r in shards.filter(F.col("id").isin(ids)).select("labels", "first", "counts").toLocalIterator()]
        block = spark.sparkContext.broadcast(held)
        parts.append(stage(dealt.mapInArrow(_match(uuid.uuid4().hex, block), "word string, n_near long, form_n long, form string")))
        block.unpersist()
    release(shards)
    if not parts:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    each = reduce(DataFrame.unionAll, parts)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))))
    reduced = each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return reduced.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from links (word, form) without cycles, by pointer doubling: each round a root is twice as far."""
    now = stage(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.filter("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(now)
        now = after
    return now.select("word", "root")


def group(words: DataFrame, ratio: int = 2, block_bytes: int = BLOCK_BYTES, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    form is the near word of greatest n, if that is ``ratio`` (2 or more, so that forms
    never lead back) times the word's own; root the last of the forms of forms.
    """
    words = stage(words.select("word", "n"))
    near = neighbours(words, block_bytes, trie_words)
    outnumbered = F.col("form_n") >= ratio * F.col("n")
    rows = words.join(near, "word").select("word", "n", "n_near", *[F.when(outnumbered, F.col(c)).alias(c) for c in ("form", "form_n")])
    rows = stage(rows)
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
