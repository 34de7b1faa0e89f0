"""Substring deduplication on words by recompression.

Every document is a sequence of words. Rounds rename it: a run of one symbol becomes one
symbol, then pairs whose left symbol falls in one half of all names and whose right symbol
in the other become one symbol. Each round is a Spark round (:func:`name_round`): the new
runs and pairs of all documents meet in parts, get numbers there, and the numbers are joined
back, so equal symbols have one name everywhere, and the part knows which occur more than once.

Equal substrings get equal interior symbols. How far "interior" reaches is tracked
exactly: each border between two symbols carries the stretch of words that decided it. A
symbol or border whose stretch lies inside a window is found again wherever the window's words
occur. So a window that repeats has only shared symbols inside; each other window is out,
and a document without a window that is left takes no part in further rounds.

1. Documents travel through the rounds in bundles of ``BUNDLE_BYTES`` of text (one row
   each: the symbols' names, lengths and stretches), so a symbol that all documents have is
   asked for once a bundle.
2. Of the borders decided inside a window that is left, the one of least fingerprint is its
   anchor. Anchors' fingerprints meet in a shuffle of packed keys; those seen once end there.
3. Windows whose anchor is shared are candidates. The few windows without an anchor
   (long periodic stretches) are candidates too. Candidates are dealt by anchor, those
   of hot anchors by all their words, so that a passage of very many documents spreads
   over parts, and compared by a fingerprint of all their words (64 bits, within a part
   of constant size): this verifies.
4. Words under a window that was met twice are removed.

A row is a document. A null text has no words; a null id is kept as null. Rows that
repeat another row count as another place, so each of them loses its windows. Texts of
any length are handled whole, by one task. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ANSWER, PACKED_DDL, QUESTION, WITNESS, Remembered, by_document, identity, is_hot, membership, pack, part_of, parts_for, shared_keys, to_documents
from .storage import release, stage, with_rid
from .textarrays import WIDEST, WORD_SEPARATOR, U, chunks, give_back, mix, portions, ragged, rolling, slice_binary, span_lists, spans_of, then_give_back

ROUNDS = 3
#: Text bytes whose symbols travel together.
BUNDLE_BYTES = 2 << 20
WORD_SEED, WINDOW_SEED, CONTEXT_SEED = 11, 12, 13
ODD, ODDER = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


class Borders:
    """Symbol borders of sequences: places, the stretch [lo, hi) that decided each, names; which symbols are new, which occur more than once."""

    def __init__(self, name: np.ndarray, row: np.ndarray, length: np.ndarray | None = None, lo: np.ndarray | None = None, hi: np.ndarray | None = None, shared: np.ndarray | None = None):
        n = len(name)
        self.at = np.arange(n) if length is None else np.cumsum(length) - length
        self.words = n if length is None else int(length.sum())
        self.name, self.row = name, row
        self.head = np.r_[True, row[1:] != row[:-1]] if n else np.zeros(0, bool)
        self.tail = np.r_[self.head[1:], True] if n else self.head
        self.lo = self.at.copy() if lo is None else self.at - lo
        self.hi = self.at.copy() if hi is None else self.at + hi
        self.end_decided = int(length is not None)
        self.fresh, self.shared = np.zeros(n, bool), np.ones(n, bool) if shared is None else shared

    def lengths(self) -> np.ndarray:
        return np.diff(np.r_[self.at, self.words])

    def _keep(self, keep: np.ndarray, name: np.ndarray, fresh: np.ndarray) -> None:
        """Drop borders. What is left now depends on its neighbours of before."""
        lo, hi = np.empty_like(self.lo), np.empty_like(self.hi)
        lo[1:], hi[:-1] = self.lo[:-1], self.hi[1:]
        lo[self.head] = self.at[self.head] - 1
        end = np.r_[self.at[self.head][1:], self.words]
        hi[self.tail] = end + self.end_decided
        self.end_decided = 1
        self.at, self.lo, self.hi, self.head, self.row = self.at[keep], lo[keep], hi[keep], self.head[keep], self.row[keep]
        self.name, self.fresh, self.shared = name, fresh, self.shared[keep] | fresh
        self.tail = np.r_[self.head[1:], True]

    def round(self, number: int) -> None:
        """Runs, then pairs. A new symbol has a fingerprint of what it stands for as its name, until it gets its number."""
        if not len(self.name):
            return
        name = self.name
        keep = self.head | np.r_[True, name[1:] != name[:-1]]
        first = np.flatnonzero(keep)
        length = np.diff(np.r_[first, len(name)])
        name = name[first]
        long = length > 1
        name[long] = mix(name[long] * ODD + length[long].astype(U) + U(2 * number))
        self._keep(keep, name, long)
        name = self.name
        right = mix(name ^ U(0xC2B2AE3D27D4EB4F ^ (number << 32))) >> U(63) == 1
        joined = np.r_[False, ~right[:-1] & right[1:]] & ~self.head
        name, fresh = name.copy(), self.fresh.copy()
        left = np.flatnonzero(joined) - 1
        name[left] = mix(name[left] * ODD + mix(name[left + 1]) * ODDER + U(2 * number + 1))
        fresh[left] = True
        self._keep(~joined, name[~joined], fresh[~joined])

    def asked(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Part and key of each distinct new symbol, in order, and whether it is here twice. New symbols are called by their place in that list."""
        name = self.name[self.fresh]
        ids, at = np.unique(identity(part_of(name, parts), name.astype(np.uint32)), return_inverse=True)
        self.name[self.fresh] = at.astype(U)
        return ids, np.bincount(at, minlength=len(ids)) > 1

    def renamed(self, number: int, part: np.ndarray, ranks: np.ndarray) -> None:
        """New symbols get the names that the round gave them: its number, their part and rank there."""
        at = self.name[self.fresh].astype(np.int64)
        names = (U(number + 1) << U(56)) | (part.astype(U) << U(32)) | (ranks & np.uint32(0x7FFFFFFF)).astype(U)
        self.name[self.fresh] = names[at]
        self.shared[self.fresh] = (ranks >> np.uint32(31) == 1)[at]

    def only(self, rows: np.ndarray) -> Borders:
        """The sequences of some rows (a mask), numbered anew."""
        keep = rows[self.row]
        number = np.cumsum(rows) - 1
        return Borders(self.name[keep], number[self.row[keep]], self.lengths()[keep], (self.at - self.lo)[keep], (self.hi - self.at)[keep], self.shared[keep])


def revealed(b: Borders, first: np.ndarray, width: int) -> np.ndarray:
    """Which windows have no symbol inside that occurs once only?"""
    alone = np.flatnonzero(~b.shared[:-1] & ~b.tail[:-1]) if len(b.at) else np.zeros(0, np.int64)
    begin, end = np.maximum(b.hi[alone + 1] - width, 0), b.lo[alone] + 1  # starts of the windows that hold it
    some = end > begin
    out = np.bincount(begin[some], minlength=b.words + 2) - np.bincount(end[some], minlength=b.words + 2)
    return np.cumsum(out)[first] == 0


def anchors(word: np.ndarray, b: Borders, first: np.ndarray, width: int):
    """Anchor of each window start in ``first``: keys, places (words), and the anchor of each start.

    The last is -1 where no border is decided inside the window.
    """
    n = len(word)
    r = rolling(CONTEXT_SEED)
    prefix = r.prefix(word)
    lo, hi = np.clip(b.lo, 0, n), np.clip(b.hi, 0, n)
    # Not the name of the symbol at the border: its end may be decided beyond hi.
    key = mix(r.slices(prefix, lo, hi) + (b.at - lo).astype(U) * ODDER + (hi - lo).astype(U))
    begin = np.cumsum(np.bincount(b.lo + 1, minlength=n + 2))[first]
    end = np.cumsum(np.bincount(b.hi, minlength=n + 2))[first + width]
    size = end - begin
    best = np.full(len(first), -1, np.int64)
    least, reach = np.arange(len(key)), 1
    while True:
        here = np.flatnonzero((size >= reach) & (size < 2 * reach))
        if len(here):
            x, y = least[begin[here]], least[end[here] - reach]
            best[here] = np.where(key[y] < key[x], y, x)
        if reach * 2 > width or len(least) <= reach:
            break
        x, y = least[:-reach], least[reach:]
        least, reach = np.where(key[y] < key[x], y, x), 2 * reach
    used = np.flatnonzero(np.r_[True, best[1:] != best[:-1]]) if len(best) else np.zeros(0, np.int64)
    used = used[best[used] >= 0]
    chosen = best[used]
    number = np.full(len(key) + 1, -1, np.int64)
    number[chosen] = np.arange(len(chosen))
    return mix(key[chosen] ^ ODD), b.at[chosen], number[best]  # mixed anew: least values crowd together


def _starts(row: np.ndarray, width: int) -> np.ndarray:
    """Starts of all windows that stay within a row."""
    n = len(row)
    return np.flatnonzero(row[: n - width + 1] == row[width - 1 :]) if n >= width else np.zeros(0, np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: most are zeros, which compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.array(np.frombuffer(data, np.uint8).reshape(size, -1).T, order="C").view(kind).reshape(-1)


BUNDLE_DDL = "kind tinyint, part int, bundle long, rids binary, symbols binary, name binary, length binary, lo binary, hi binary, flags binary, keys binary, twice binary"
BUNDLES = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("bundle", pa.int64()), *((c, pa.binary()) for c in ("rids", "symbols", "name", "length", "lo", "hi", "flags", "keys", "twice"))])
STATE, ASKED = 0, 1
FRESH, SHARED = 1, 2


def _bundle_rows(b: Borders, rids: np.ndarray, parts: int) -> pa.RecordBatch:
    """The bundle's symbols as one row, and what it asks for as one row per part."""
    bundle = int.from_bytes(os.urandom(8), "little") >> 1
    ids, twice = b.asked(parts)
    part = (ids >> U(32)).astype(np.int32)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(ids) else np.zeros(0, np.int64)
    n = len(at)
    border = np.r_[at, len(ids)]
    flags = b.fresh * np.uint8(FRESH) | b.shared * np.uint8(SHARED)
    state = {
        "rids": rids.tobytes(), "symbols": np.bincount(b.row, minlength=len(rids)).astype(np.int32).tobytes(), "name": _planes(b.name), "length": _planes(b.lengths().astype(np.int32)),
        "lo": _planes((b.at - b.lo).astype(np.int32)), "hi": _planes((b.hi - b.at).astype(np.int32)), "flags": flags.astype(np.uint8).tobytes(),
    }
    none = slice_binary(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    own = [pa.concat_arrays([pa.array([v], pa.binary()), none]) for v in state.values()]
    first = pa.array([b""], pa.binary())
    asks = [pa.concat_arrays([first, slice_binary(x, border)]) for x in (ids.astype(np.uint32), twice.astype(np.uint8))]
    return pa.RecordBatch.from_arrays([pa.array(np.r_[STATE, np.full(n, ASKED)].astype(np.int8)), pa.array(np.r_[-1, part[at]].astype(np.int32)), pa.array(np.full(n + 1, bundle)), *own, *asks], schema=BUNDLES)


def _opened(batch: pa.RecordBatch, i: int, number: int, width: int) -> tuple[Borders, np.ndarray]:
    """A bundle with the names that round ``number`` gave to its new symbols, and its rows' ids; rows without a window that may repeat are gone."""
    get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
    rids, symbols, flags = get("rids", np.int64), get("symbols", np.int32), get("flags", np.uint8)
    name, length, lo, hi = (_unplaned(batch.column(c)[i].as_buffer(), kind) for c, kind in (("name", U), ("length", np.int32), ("lo", np.int32), ("hi", np.int32)))
    b = Borders(name, np.repeat(np.arange(len(rids)), symbols), length.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64), flags & SHARED > 0)
    b.fresh = flags & FRESH > 0
    found = batch.column("found")[i]
    if found.is_valid:
        pieces = sorted((x["part"], x["ranks"]) for x in found.as_py())
        ranks = [np.frombuffer(r, np.uint32) for _, r in pieces]
        b.renamed(number, np.repeat([p for p, _ in pieces], [len(r) for r in ranks]), np.concatenate(ranks))
    row = np.repeat(b.row, length)
    first = _starts(row, width)
    stay = np.zeros(len(rids), bool)
    stay[row[first[revealed(b, first, width)]]] = True
    return b.only(stay), rids[stay]


def _first_round(width: int, parts: int):
    """Bundles of the texts that have a window at all."""

    def run(batches):
        for batch in portions(batches):
            rids = batch.column("rid").to_numpy()
            for chunk in chunks(batch.column("text"), BUNDLE_BYTES):
                start, end, row = chunk.words(WORD_SEPARATOR)
                enough = np.bincount(row, minlength=chunk.rows) >= width
                if not enough.any():
                    continue
                word = chunk.fingerprints(start, end, WORD_SEED)
                some = enough[row]
                # 32 bits for a word: two that share a name are told apart by the last comparison.
                b = Borders(word[some] & U(0xFFFFFFFF), (np.cumsum(enough) - 1)[row[some]])
                b.round(0)
                yield _bundle_rows(b, rids[chunk.lo : chunk.hi][enough], parts)

    return run


def _next_round(number: int, width: int, parts: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, rids = _opened(batch, i, number - 1, width)
                if len(rids):
                    b.round(number)
                    yield _bundle_rows(b, rids, parts)
        give_back()

    return run


def _numbered(table: pa.Table) -> pa.Table:
    """Ranks of a part's distinct keys, for each bundle that asked, in the order of its keys; the top bit says that a key occurs more than once."""
    table = table.combine_chunks()
    column = lambda c: pa.concat_arrays(table[c].chunks)
    keys, counts = ragged(column("keys"), np.uint32)
    twice = ragged(column("twice"), np.uint8)[0] > 0
    _, at = np.unique(keys, return_inverse=True)
    shared = (np.bincount(at) > 1) | (np.bincount(at, weights=twice) > 0) if len(at) else np.zeros(0, bool)
    ranks = at.astype(np.uint32) | (shared[at].astype(np.uint32) << np.uint32(31))
    return pa.table({"bundle": column("bundle"), "part": column("part"), "ranks": slice_binary(ranks, np.r_[0, np.cumsum(counts)])})


def name_round(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bundles of a round with ``found``: the numbers of their new runs and pairs, from all bundles' questions; the staged numbers."""
    asked = rows.filter(F.col("kind") == ASKED).select("part", "bundle", "keys", "twice")
    numbers = stage(asked.groupBy("part").applyInArrow(then_give_back(_numbered), "bundle long, part int, ranks binary"))
    found = numbers.groupBy("bundle").agg(F.collect_list(F.struct("part", "ranks")).alias("found"))
    state = rows.filter(F.col("kind") == STATE).drop("kind", "part", "keys", "twice")
    return state.join(found, "bundle", "left"), numbers


def _unbundled(number: int, width: int):
    """(rid, length, lo, hi, shared) of each document with a window that may repeat."""
    names = ["rid", "length", "lo", "hi", "shared"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, rids = _opened(batch, i, number, width)
                border = np.searchsorted(b.row, np.arange(len(rids) + 1))
                columns = [b.lengths().astype(np.int32), (b.at - b.lo).astype(np.int32), (b.hi - b.at).astype(np.int32), b.shared.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(rids), *(slice_binary(c, border) for c in columns)], names=names)
        give_back()

    return run


def compressed(docs: DataFrame, width: int, parts: int, rounds: int = ROUNDS) -> DataFrame:
    """Staged (rid, length, lo, hi, shared): the symbols of each text (rid, text) after the rounds, one row per rid; texts without a window that may repeat have none."""
    rows = stage(docs.select("rid", "text").mapInArrow(_first_round(width, parts), BUNDLE_DDL))
    for number in range(1, rounds):
        named, numbers = name_round(rows)
        after = stage(named.mapInArrow(_next_round(number, width, parts), BUNDLE_DDL))
        release(rows, numbers)
        rows = after
    named, numbers = name_round(rows)
    each = named.mapInArrow(_unbundled(rounds - 1, width), "rid long, length binary, lo binary, hi binary, shared binary")
    # Rows that share a rid have one text.
    out = stage(each.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("length", "lo", "hi", "shared")]))
    release(rows, numbers)
    return out


def _parsed(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """Chunks with their words' fingerprints, symbols, and the starts of the windows that may repeat."""
    for chunk in chunks(batch.column("text")):
        start, end, row = chunk.words(WORD_SEPARATOR)
        first = _starts(row, width)
        if not len(first):
            continue
        word = chunk.fingerprints(start, end, WORD_SEED)
        part = batch.slice(chunk.lo, chunk.rows)
        (length, symbols), lo, hi = ragged(part.column("length"), np.int32), *(ragged(part.column(c), np.int32)[0] for c in ("lo", "hi"))
        shared = ragged(part.column("shared"), np.uint8)[0] > 0
        b = Borders(np.zeros(len(length), U), np.repeat(np.arange(chunk.rows), symbols), *(x.astype(np.int64) for x in (length, lo, hi)), shared)
        first = first[revealed(b, first, width)]
        if len(first):
            yield chunk, row, word, b, first


def _packed(batch, parts, part, key, doc, sent):
    if key:
        rids = batch.column("rid").to_numpy()
        yield from pack(np.concatenate(part), np.concatenate(key), np.concatenate(doc), rids, parts, True, sent)


def _name_anchors(width: int, parts: int):
    def run(batches):
        sent = Remembered()
        for batch in portions(batches):
            part, keys, docs = [], [], []
            for chunk, row, word, b, first in _parsed(batch, width):
                key, place, _ = anchors(word, b, first, width)
                part.append(part_of(key, parts))
                keys.append(key.astype(np.uint32))
                docs.append(row[place] + chunk.lo)
            yield from _packed(batch, parts, part, keys, docs, sent)

    return run


RUNS_DDL = "part int, kind tinyint, docs binary, starts binary, counts binary, keys binary"
RUNS = pa.schema([("part", pa.int32()), ("kind", pa.int8()), *((c, pa.binary()) for c in ("docs", "starts", "counts", "keys"))])


def _run_rows(kind: int, part, doc, start, key) -> pa.RecordBatch:
    """Windows in order of document and place, as runs of consecutive starts, one row per part."""
    order = np.argsort(part, kind="stable")
    part, doc, start = part[order], doc[order], start[order]
    n = len(part)
    turn = np.r_[True, part[1:] != part[:-1]] if n else np.zeros(0, bool)
    at = np.flatnonzero(turn)
    run = np.flatnonzero(turn | np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if n else at
    border = np.r_[at, n]
    by = np.r_[np.searchsorted(run, at), len(run)]
    none = slice_binary(np.zeros(0, np.int64), np.zeros(len(border), np.int64))
    runs = [none] * 3 if kind == WITNESS else [slice_binary(x, by) for x in (doc[run], start[run], np.diff(np.r_[run, n]).astype(np.int32))]
    keys = none if kind == ANSWER else slice_binary(key[order], border)
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int8)), *runs, keys], schema=RUNS)


def _send_windows(width: int, parts: int, hot: np.ndarray | None):
    """Candidate windows, dealt by their anchor, so that neighbours travel and are answered as runs.

    Windows of hot anchors are dealt one by one. Windows that the task has seen twice are
    settled here, with one witness each.
    """

    def run(batches):
        sent = Remembered()
        for batch in portions(batches):
            found = []
            for chunk, row, word, b, first in _parsed(batch, width):
                key, place, anchor = anchors(word, b, first, width)
                hit = membership(row[place], key.astype(np.uint32), batch.column("found").slice(chunk.lo, chunk.rows), np.uint32)
                some = np.r_[hit, True][anchor]  # -1: without an anchor
                first, anchor = first[some], anchor[some]
                r = rolling(WINDOW_SEED)
                whole = mix(r.windows(r.prefix(word), width)[first])
                alone = np.r_[is_hot(hot, part_of(key, parts), key.astype(np.uint32)), True][anchor]
                deal = np.where(alone, mix(whole), np.r_[key, U(0)][anchor])
                found.append((part_of(deal, parts), whole, row[first] + chunk.lo, first - np.searchsorted(row, row[first])))
            if not found:
                continue
            part, key, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(key):
                continue
            rids = batch.column("rid").to_numpy()
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]]
            name = np.cumsum(new) - 1
            again, before = np.bincount(name) > 1, sent.has(ordered[new])
            twice = np.zeros(len(key), bool)
            twice[order] = (again | before)[name]
            seen = np.zeros(len(key), bool)
            seen[order[new]] = again & ~before
            sent.add(ordered[new][again & ~before])
            ask = ~twice
            yield _run_rows(QUESTION, part[ask], rids[row[ask]], start[ask], key[ask])
            if twice.any():
                yield _run_rows(WITNESS, part[seen], row[seen], start[seen], key[seen])
                yield _run_rows(ANSWER, part_of(mix(rids.astype(U)), parts)[row[twice]], rids[row[twice]], start[twice], key[twice])

    return run


def _settle_windows(width: int, parts: int):
    """Spans of words under windows that were met twice, on their way back."""

    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind = table["kind"].to_numpy()

        def values(name, k, dtype):
            column = table[name].filter(pa.array(kind == k))
            return ragged(pa.concat_arrays(column.chunks), dtype)[0] if len(column) else np.zeros(0, dtype)

        doc, start = values("docs", QUESTION, np.int64), values("starts", QUESTION, np.int64)
        counts = values("counts", QUESTION, np.int32).astype(np.int64)
        key = values("keys", QUESTION, U)
        every = np.concatenate([key, values("keys", WITNESS, U)])
        order = np.argsort(every, kind="stable")
        same = every[order[1:]] == every[order[:-1]]
        hit = np.zeros(len(every), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        run = np.repeat(np.arange(len(doc)), counts)
        place = start[run] + np.arange(len(run)) - (np.cumsum(counts) - counts)[run]
        first, end = spans_of(hit[: len(key)], run)
        settled = values("starts", ANSWER, np.int64)
        begin = np.concatenate([place[first], settled])
        stop = np.concatenate([place[end - 1] + width, settled + values("counts", ANSWER, np.int32) - 1 + width])
        owner = np.concatenate([doc[run[first]], values("docs", ANSWER, np.int64)])
        return to_documents(np.repeat(owner, 2), np.stack([begin, stop], axis=1).reshape(-1), parts)

    return settle


def joined_words(chunk, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> pa.Array:
    """Each row's words, joined by one space."""
    length = end - start
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    take = length + ~last
    out = np.cumsum(take)
    total = int(out[-1]) if len(out) else 0
    source = np.arange(total) + np.repeat(start - (out - take), take)
    text = np.r_[chunk.data, np.uint8(0x20)][source]
    text[(out - 1)[~last]] = 0x20
    border = np.zeros(chunk.rows + 1, np.int64)
    border[1:] = np.cumsum(np.bincount(row, weights=take, minlength=chunk.rows)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), chunk.rows, [None, pa.py_buffer(border), pa.py_buffer(text)]).cast(pa.string())


def _remove():
    def run(batches):
        for batch in portions(batches):
            for chunk in chunks(batch.column("text")):
                start, end, row = chunk.words(WORD_SEPARATOR)
                part = batch.slice(chunk.lo, chunk.rows)
                flat, counts = ragged(part.column("found"), np.int64)
                shift = np.searchsorted(row, np.repeat(np.arange(chunk.rows), counts // 2))
                n = len(row)
                step = np.bincount(flat[0::2] + shift, minlength=n + 1) - np.bincount(flat[1::2] + shift, minlength=n + 1)
                gone = np.cumsum(step[:n]) > 0
                s, e = spans_of(gone, row)
                base = np.searchsorted(row, np.arange(chunk.rows))
                spans = span_lists(s - base[row[s]], e - base[row[s]], row[s], chunk.rows)
                stay = ~gone
                count = lambda mask: pa.array(np.bincount(row[mask], minlength=chunk.rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), count(slice(None)), count(gone), spans, joined_words(chunk, start[stay], end[stay], row[stay])],
                    names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
                )

    return run


RESULT = "n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string"


def remove_repeats(docs: DataFrame, width: int = 35, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document without the words that a repeated window of ``width`` words covers.

    Returns doc_id, n_words, n_removed, removed (spans of word numbers) and kept_text
    (kept words, joined by one space), one row for each row of ``docs``.
    """
    if not 2 <= width <= WIDEST:
        raise ValueError(f"a window has 2 to {WIDEST} words")
    id_type = docs.schema[id_column].dataType.simpleString()
    docs = with_rid(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    parts = parts_for(docs)
    symbols = compressed(docs, width, parts)
    texts = docs.select("rid", "text").join(symbols, "rid")
    named = texts.mapInArrow(_name_anchors(width, parts), PACKED_DDL)
    shared, hot = shared_keys(named, np.uint32, parts)
    candidates = texts.join(shared, "rid", "left")
    windows = candidates.mapInArrow(_send_windows(width, parts, hot), RUNS_DDL)
    spans = stage(by_document(windows.groupBy("part").applyInArrow(then_give_back(_settle_windows(width, parts)), PACKED_DDL), np.int64))
    release(shared, symbols)
    return docs.join(spans, "rid", "left").mapInArrow(_remove(), f"doc_id {id_type}, {RESULT}")
