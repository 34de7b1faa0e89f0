"""Which keys occur in more than one place? A shuffle of packed keys.

Mappers call :func:`pack` with the keys of many documents. Keys are dealt to
``parts`` by hash and travel as packed arrays, so a shuffled row holds hundreds of
keys. Keys that a mapper already sees twice are settled there: it sends one witness
with their number and routes the answers by document, so a key that a third of all
documents hold costs its part one entry per mapper task, not one per document.
:func:`shared_keys` returns, per document, the keys that occur elsewhere; answers
travel back packed as well, so rows number parts times parts, not documents times parts.

What is dealt by a key later on would all meet in that key's part. So parts also report
their hot keys, those with as many documents as an eighth of the part's entries, and
:func:`hot_keys` hands them out as a list of bounded size, or None where they are too
many and all keys are to be taken as hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shuffle_width, stage
from .textarrays import U, give_back, mix, ragged, slice_binary, then_give_back

PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
PACKED_DDL = "part int, kind tinyint, docs binary, counts binary, keys binary"
QUESTION, WITNESS, ANSWER, HOT = 0, 1, 2, 3
#: A key is hot from so many documents on, or from this share of its part's entries; entries of the list of hot keys.
HOT_LEAST, HOT_SHARE, HOT_LIST = 64, 8, 1 << 20
#: Keys that a task remembers to have sent a witness for (8 bytes each).
REMEMBERED = 1 << 20
#: Text bytes for each part: keeps a part at about a million keys at every scale.
PART_BYTES = 16 << 20


def parts_for(df: DataFrame, column: str = "text", part_bytes: int = PART_BYTES) -> int:
    """Number of parts: in proportion to the bytes, and one for each shuffle partition at least."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0]
    return max(shuffle_width(df.sparkSession), 1 + total // part_bytes)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def identity(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Part and key of 32 bits as one number."""
    return (part.astype(U) << U(32)) | key.astype(U)


class Remembered:
    """Keys of which this task has sent a witness. A key that is forgotten costs one witness more."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit, self.keys = limit, np.zeros(0, U)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def add(self, keys: np.ndarray) -> None:
        both = np.union1d(self.keys, keys)
        self.keys = both if len(both) <= self.limit else np.unique(keys)[: self.limit]


def _rows(kind: int, part, doc, key, rids, number=None) -> pa.RecordBatch:
    """One row per part: its documents, the number of keys of each, the keys. A witness has the ``number`` of documents of each key instead."""
    order = np.lexsort((doc, part))
    part, doc, key = part[order], doc[order], key[order]
    n = len(part)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if n else np.zeros(0, np.int64)
    borders = np.r_[at, n]
    if kind == WITNESS:
        docs = slice_binary(np.zeros(0, np.int64), np.zeros(len(at) + 1, np.int64))
        counts = slice_binary(number[order].astype(np.int32), borders)
    else:
        one = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]) if n else at
        by = np.r_[np.searchsorted(one, at), len(one)]
        docs = slice_binary(rids[doc[one]], by)
        counts = slice_binary(np.diff(np.r_[one, n]).astype(np.int32), by)
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int8)), docs, counts, slice_binary(key, borders)], schema=PACKED)


def pack(part: np.ndarray, key: np.ndarray, doc: np.ndarray, rids: np.ndarray, parts: int, within: bool, sent: Remembered):
    """Packed rows for keys ``key`` (32 bits, dealt to ``part``) of documents ``rids[doc]``; ``doc`` ascends.

    within: a key that one document holds twice counts as shared. ``sent``: what the task
    has settled before; its keys are settled at sight.
    """
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    part, key, doc = part[order], key[order], doc[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
    first = new | np.r_[True, doc[1:] != doc[:-1]]
    run = np.cumsum(new) - 1
    docs_in = np.bincount(run[first])
    shared = docs_in > 1
    if within:
        shared |= np.bincount(run) > 1
    head = np.flatnonzero(new)
    before = sent.has(identity(part[head], key[head]))
    known = (shared | before)[run[first]]
    part1, key1, doc1 = part[first], key[first], doc[first]
    yield _rows(QUESTION, part1[~known], doc1[~known], key1[~known], rids)
    if known.any():
        tell = shared & ~before
        head = head[tell]
        sent.add(identity(part[head], key[head]))
        yield _rows(WITNESS, part[head], doc[head], key[head], rids, docs_in[tell])
        to = part_of(mix(rids.astype(U)), parts)[doc1[known]]
        yield _rows(ANSWER, to, doc1[known], key1[known], rids)


def _column(table: pa.Table, name: str, kind: int) -> pa.Array:
    chunks = table[name].filter(pa.array(table["kind"].to_numpy() == kind)).chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.binary())


def _settle(dtype, parts: int, distinct: bool):
    def settle(table: pa.Table) -> pa.Table:
        own = table["part"][0].as_py()
        keys, docs = {}, {}
        for k in (QUESTION, WITNESS, ANSWER):
            keys[k] = ragged(_column(table, "keys", k), dtype)[0]
            if k != WITNESS:
                docs[k] = np.repeat(ragged(_column(table, "docs", k), np.int64)[0], ragged(_column(table, "counts", k), np.int32)[0])
        asked = keys[QUESTION]
        every = np.concatenate([asked, keys[WITNESS]])
        number = np.concatenate([np.ones(len(asked), np.int64), ragged(_column(table, "counts", WITNESS), np.int32)[0]])
        # A key is shared if it has two entries (of two documents, if distinct); a witness stands for more than one.
        who = np.concatenate([docs[QUESTION], np.full(len(keys[WITNESS]), np.iinfo(np.int64).max)])
        order = np.lexsort((who, every)) if distinct else np.argsort(every, kind="stable")
        ordered = every[order]
        at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        last = np.r_[at[1:], len(ordered)] - 1 if len(at) else at
        shared = who[order[at]] != who[order[last]] if distinct else last > at
        hit = np.zeros(len(every), bool)
        hit[order] = np.repeat(shared, last - at + 1)
        hit = hit[: len(asked)]
        doc = np.concatenate([docs[QUESTION][hit], docs[ANSWER]])
        answers = to_documents(doc, np.concatenate([asked[hit], keys[ANSWER]]), parts)
        total = np.add.reduceat(number[order], at) if len(at) else at
        hot = ordered[at][total >= max(HOT_LEAST, len(every) // HOT_SHARE)]
        if len(hot):
            names = identity(np.full(len(hot), own), hot)
            none = slice_binary(np.zeros(0, np.int64), np.zeros(2, np.int64))
            row = pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([HOT], pa.int8()), none, none, slice_binary(names, np.array([0, len(names)]))], schema=PACKED)
            answers = pa.concat_tables([answers, pa.Table.from_batches([row])])
        return answers

    return settle


def to_documents(doc: np.ndarray, values: np.ndarray, parts: int) -> pa.Table:
    """Packed values on their way to the documents they belong to: the end of a part's work."""
    give_back()
    rids, at = np.unique(doc, return_inverse=True)
    return pa.Table.from_batches([_rows(QUESTION, part_of(mix(rids.astype(U)), parts)[at], at, values, rids)])


def _by_document(dtype):
    def run(table: pa.Table) -> pa.Table:
        doc = np.repeat(ragged(_column(table, "docs", QUESTION), np.int64)[0], ragged(_column(table, "counts", QUESTION), np.int32)[0])
        values = ragged(_column(table, "keys", QUESTION), dtype)[0]
        order = np.argsort(doc, kind="stable")
        doc, values = doc[order], values[order]
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        out = pa.table({"rid": pa.array(doc[at], pa.int64()), "found": slice_binary(values, np.r_[at, len(doc)])})
        hot = _column(table, "keys", HOT)
        return pa.concat_tables([out, pa.table({"rid": pa.nulls(len(hot), pa.int64()), "found": hot})]) if len(hot) else out

    return run


def by_document(packed: DataFrame, dtype) -> DataFrame:
    """(rid, found: its packed values), one row per document; rows without rid hold hot keys."""
    return packed.groupBy("part").applyInArrow(then_give_back(_by_document(dtype)), "rid long, found binary")


def shared_keys(packed: DataFrame, dtype, parts: int, distinct: bool = False) -> tuple[DataFrame, np.ndarray | None]:
    """Staged (rid, found: packed keys) for every document that holds a shared key; the hot keys.

    distinct: entries of one document from several mappers count once.
    """
    found = stage(by_document(packed.groupBy("part").applyInArrow(then_give_back(_settle(dtype, parts, distinct)), PACKED_DDL), dtype))
    return found.filter("rid is not null"), hot_keys(found.filter("rid is null"))


def hot_keys(rows: DataFrame) -> np.ndarray | None:
    """The sorted identities in ``found``, or None if they are more than ``HOT_LIST``."""
    size = rows.agg(F.sum(F.octet_length("found"))).first()[0] or 0
    if size > 8 * HOT_LIST:
        return None
    return np.unique(np.frombuffer(b"".join(bytes(r.found) for r in rows.select("found").collect()), U))


def is_hot(hot: np.ndarray | None, part: np.ndarray, key: np.ndarray) -> np.ndarray:
    if hot is None:
        return np.ones(len(key), bool)
    return np.isin(identity(part, key), hot) if len(hot) else np.zeros(len(key), bool)


def membership(doc: np.ndarray, key: np.ndarray, answers: pa.Array, dtype) -> np.ndarray:
    """Which (doc, key) are in ``answers``, the ``found`` column of the same rows?

    Both are compared as one 64-bit mix of row and key.
    """
    flat, counts = ragged(answers, dtype)
    row = np.repeat(np.arange(len(answers)), counts)
    join = lambda d, k: mix(k.astype(U) ^ (d.astype(U) * U(0x9E3779B97F4A7C15)))
    held = np.sort(join(row, flat))
    if not len(held) or not len(key):
        return np.zeros(len(key), bool)
    out = np.zeros(len(key), bool)
    some = np.zeros(len(answers), bool)
    some[row] = True
    ask = np.flatnonzero(some[doc])
    asked = join(doc[ask], key[ask])
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    out[ask] = held[at] == asked
    return out
