"""Byte-level deduplication with suffix sorting (deep-shallow).

Removed is each byte under a string of ``width`` bytes that also starts in a document
with a smaller id.

1. Of rows with equal texts (by MD5) only those of the smallest id go on; the others
   lose all they have, if that is a window at least.
2. Every window of ``width`` bytes has a minimizer: its ``GRAM`` bytes of least
   fingerprint. Equal windows have equal minimizers at equal places. Fingerprints of
   minimizers meet in a shuffle of packed keys; what one text alone has ends there.
3. Runs of windows with one shared minimizer travel as one string, dealt by the
   minimizer, so equal windows meet. Windows of hot minimizers (common bytes in many
   surroundings) travel one by one, dealt by all their bytes. A mapper that holds a
   string twice keeps the smallest id's and settles the others, and it remembers hot
   windows that it has sent, so a passage that a third of all documents hold costs a
   part some strings per mapper task.
4. Each part drops strings it holds of a smaller id and sorts the other suffixes:
   buckets of two bytes, in them multikey quicksort on characters of 8 bytes, all
   partitions in step, down to ``SHALLOW`` bytes; groups that still agree there and
   differ later are ordered by blind tries.
   Neighbours that agree in ``width`` bytes are equal windows; the smallest id keeps them.

Null text is empty. A null id is larger than all others. Rows that share an id do not
remove each other's text; repeated rows come out alike. Texts of any length are handled
whole, by one task. An empty table gives an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import PACKED_DDL, Remembered, by_document, is_hot, membership, pack, part_of, parts_for, shared_keys, to_documents
from .storage import release, stage, with_rid
from .textarrays import WIDEST, U, binary_buffers, chunks, equal_slices, gather, mix, portions, ragged, rolling, slice_binary, span_lists, spans_of, then_give_back

GRAM = 16
SHALLOW = 40
#: Partitions of so many strings are left to a simpler sort.
FEW = 64
#: Text bytes for each part: its windows take some tens of MB to sort.
PART_BYTES = 4 << 20
PIECE = 1 << 20
GRAM_SEED = 31
NO_ID = np.iinfo(np.int64).max


def strings(chunk, width: int):
    """Runs of windows with one minimizer: starts, ends (bytes), rows and keys, piece by piece."""
    data, n = chunk.data, len(chunk.data)
    r = rolling(GRAM_SEED)
    row_end = chunk.offset[1:]
    held = None
    for a in range(0, max(0, n - width + 1), PIECE):
        piece = data[a : a + PIECE + width - 1]
        hashed = mix(r.windows(r.prefix(r.byte_value[piece]), GRAM))
        low = U((1 << 21) - 1)
        least = (hashed & ~low) | np.arange(len(hashed), dtype=U)
        span = width - GRAM + 1
        reach = 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if span > reach:
            rest = span - reach
            least = np.minimum(least[:-rest], least[rest:])
        at = (least & low).astype(np.int64)
        start = np.arange(a, a + len(at))
        row = np.searchsorted(chunk.offset, start, "right") - 1
        fits = start + width <= row_end[row]
        at, start, row = at[fits] + a, start[fits], row[fits]
        if not len(at):
            continue
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
        last = np.r_[first[1:], len(at)] - 1
        yield start[first], start[last] + width, row[first], mix(hashed[at[first] - a] ^ U(0xA0761D6478BD642F))


def _name_minimizers(width: int, parts: int):
    def run(batches):
        sent = Remembered()
        for batch in portions(batches):
            names, first, at = np.unique(batch.column("th").to_numpy(), return_index=True, return_inverse=True)
            new = np.zeros(batch.num_rows, bool)
            new[first] = True
            keys, docs = [], []
            for chunk in chunks(batch.column("text")):
                for _, _, row, key in strings(chunk, width):
                    mine = new[row + chunk.lo]
                    keys.append(key[mine])
                    docs.append(at[row[mine] + chunk.lo])
            if keys:
                key, doc = np.concatenate(keys), np.concatenate(docs)
                order = np.argsort(doc, kind="stable")
                key, doc = key[order], doc[order]
                yield from pack(part_of(key, parts), key.astype(np.uint32), doc, names, parts, False, sent)

    return run


STRINGS_DDL = "part int, kind tinyint, rids binary, ids binary, docs binary, starts binary, lengths binary, bytes binary"
STRINGS = pa.schema([("part", pa.int32()), ("kind", pa.int8()), *((c, pa.binary()) for c in ("rids", "ids", "docs", "starts", "lengths", "bytes"))])
ASKED, SETTLED = 0, 1


def _string_rows(kind: int, part, row, rids, ids, start, length, text) -> pa.RecordBatch:
    """One row per part: the documents' ids once, then each string's document, place and bytes (packed by zstd).

    ``text`` is None or (data, offset of each string in it).
    """
    order = np.lexsort((row, part))
    part, row = part[order], row[order]
    turn = np.r_[True, part[1:] != part[:-1]] if len(part) else np.zeros(0, bool)
    at = np.flatnonzero(turn)
    border = np.r_[at, len(part)]
    fresh = turn | np.r_[True, row[1:] != row[:-1]] if len(part) else turn
    one = np.flatnonzero(fresh)
    by = np.r_[np.searchsorted(one, at), len(one)]
    doc = np.cumsum(fresh) - 1
    doc -= by[np.cumsum(turn) - 1] if len(part) else 0
    tables = [slice_binary(x[row[one]], by) for x in (rids, ids)]
    columns = [slice_binary(x, border) for x in (doc.astype(np.int32), start[order].astype(np.int32), length[order].astype(np.int32))]
    if text is None:
        body = slice_binary(np.zeros(0, np.uint8), np.zeros(len(border), np.int64))
    else:
        length = length[order]
        raw = gather(text[0], text[1][order], length)
        cut = np.r_[0, np.cumsum(length)][border].tolist()
        body = pa.array([pa.compress(raw[a:b], codec="zstd", asbytes=True) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(np.full(len(at), kind, np.int8)), *tables, *columns, body], schema=STRINGS)


def settled_strings(data: np.ndarray, place: np.ndarray, length: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """Which strings are also held, byte for byte, by a smaller id?"""
    r = rolling(GRAM_SEED)
    name = np.zeros(len(place), U)
    for lo in range(0, len(place), 1 << 14):
        hi = min(lo + (1 << 14), len(place))
        base = place[lo]
        piece = data[base : place[hi - 1] + length[hi - 1]]
        name[lo:hi] = mix(r.slices(r.prefix(r.byte_value[piece]), place[lo:hi] - base, place[lo:hi] - base + length[lo:hi])) + length[lo:hi].astype(U)
    order = np.lexsort((ident, name))
    n, i = name[order], ident[order]
    again = np.r_[False, n[1:] == n[:-1]]
    again[again] = _same_text(data, place, length, order, np.flatnonzero(again))
    owner = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    out = np.zeros(len(place), bool)
    out[order] = again & (i > i[owner])
    return out


def _same_text(data, place, length, order, at) -> np.ndarray:
    """Does string ``order[at]`` equal the one before it, byte for byte?"""
    a, b = order[at], order[at - 1]
    same = length[a] == length[b]
    return same & equal_slices(data, place[a], data, place[b], np.where(same, length[a], 0))


def single_windows(data, start, end, row, key, width: int):
    """Each window of strings of ``data`` as a string of its own, keyed by all its bytes; per piece of windows."""
    windows = end - start - width + 1
    for lo in range(0, len(start), 1 << 13):
        w = windows[lo : lo + (1 << 13)]
        first = np.repeat(start[lo : lo + (1 << 13)] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        name = np.zeros(len(first), U)
        for d in range(0, width, 8):  # 8 bytes at a time, the last of them up to the end
            d = min(d, width - 8)
            name = mix(name ^ (np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[first + d] + U(d)))
        yield first, first + width, np.repeat(row[lo : lo + (1 << 13)], w), name


#: Hot windows that a task remembers to have sent (their bytes and ids).
HOT_WINDOWS = 1 << 16


def _send_strings(width: int, parts: int, hot: np.ndarray | None):
    def run(batches):
        past = np.zeros(0, np.uint8), np.zeros(0, np.int64)  # bytes and ids of hot windows sent before
        for batch in portions(batches):
            rids = batch.column("rid").to_numpy()
            ids = batch.column("ident").to_numpy()
            answers = batch.column("found")
            size = np.diff(binary_buffers(batch.column("text"))[0])
            copies = np.flatnonzero(batch.column("later").to_numpy(zero_copy_only=False).astype(bool) & (size >= width))
            home = part_of(mix(rids.astype(U)), parts)
            if len(copies):
                yield _string_rows(SETTLED, home[copies], copies, rids, ids, np.zeros(len(copies), np.int64), size[copies], None)
            found = []
            for chunk in chunks(batch.column("text")):
                for start, end, row, key in strings(chunk, width):
                    hit = membership(row, key.astype(np.uint32), answers.slice(chunk.lo, chunk.rows), np.uint32)
                    start, end, row, key = start[hit], end[hit], row[hit], key[hit]
                    common = is_hot(hot, part_of(key, parts), key.astype(np.uint32))
                    taken = [(start[~common], end[~common], row[~common], key[~common], False)]
                    taken += [(*x, True) for x in single_windows(chunk.data, start[common], end[common], row[common], key[common], width)]
                    for start, end, row, key, single in taken:  # noqa: PLW2901
                        if len(start):
                            found.append((key, row + chunk.lo, start - chunk.offset[row], end - start, np.full(len(key), single), gather(chunk.data, start, end - start)))
            if not found:
                continue
            key, row, start, length, single = (np.concatenate([f[k] for f in found]) for k in range(5))
            data = np.concatenate([past[0], *[f[5] for f in found]])
            every = np.concatenate([np.full(len(past[1]), width), length])
            place = np.cumsum(every) - every
            done = settled_strings(data, place, every, np.concatenate([past[1], ids[row]]))[len(past[1]) :]
            place = place[len(past[1]) :]
            ask = ~done
            new = np.flatnonzero(ask & single)
            new = new[np.unique(key[new], return_index=True)[1]][:HOT_WINDOWS]
            sent = gather(data, place[new], length[new]), ids[row[new]]
            past = tuple(np.concatenate(x) for x in zip(past, sent, strict=True)) if len(past[1]) + len(new) <= HOT_WINDOWS else sent
            yield _string_rows(ASKED, part_of(mix(key[ask]), parts), row[ask], rids, ids, start[ask], length[ask], (data, place[ask]))
            if done.any():
                yield _string_rows(SETTLED, home[row[done]], row[done], rids, ids, start[done], length[done], None)

    return run


class BlindTrie:
    """Orders strings that share a prefix: a trie of branching places only, then one comparison."""

    def __init__(self, width: int):
        self.width = width
        self.root = None

    def add(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = [self.width, text, [item]]
            return
        node = self.root
        while node[0] < self.width:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        x = int.from_bytes(text, "big") ^ int.from_bytes(node[1], "big")
        if not x:
            node[2].append(item)
            return
        depth = self.width - (x.bit_length() + 7) // 8
        other, parent, branch = node[1], None, None
        node = self.root
        while node[0] < depth:
            parent, branch = node, text[node[0]]
            node = node[1][branch]
        leaf = [self.width, text, [item]]
        if node[0] == depth and depth < self.width:
            node[1][text[depth]] = leaf
            return
        fork = [depth, {text[depth]: leaf, other[depth]: node}]
        if parent is None:
            self.root = fork
        else:
            parent[1][branch] = fork

    def leaves(self):
        """Items of equal strings, in order of the strings."""
        waiting = [self.root] if self.root else []
        while waiting:
            node = waiting.pop()
            if node[0] == self.width:
                yield node[2]
            else:
                waiting += [node[1][c] for c in sorted(node[1], reverse=True)]


def _pivots(c: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The median of three of each partition's characters."""
    a, b, d = c[first], c[first + size // 2], c[first + size - 1]
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), d))


def _sort_few(char, start, order, first, size, shallow: int) -> np.ndarray:
    """Orders small partitions in place, as quicksort leaves them to a simpler sort; where new partitions begin."""
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) + (first - (np.cumsum(size) - size))[owner]
    keys = [char[start[order[at]] + d].astype(U) for d in range(0, shallow, 8)]
    by = np.lexsort((*keys[::-1], owner))
    order[at] = order[at[by]]
    new = np.r_[True, owner[1:] != owner[:-1]]
    for key in keys:
        key = key[by]
        new[1:] |= key[1:] != key[:-1]
    return at[new]


def sort_suffixes(data: np.ndarray, start: np.ndarray, width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings ``data[s:s + width]``, and the number of each one's class of equals.

    Multikey quicksort: a partition is split by a pivot character (8 bytes) into the strings
    below, at and above it; those at the pivot go on with the next character, the others
    with the same one. All open partitions take their step at once. A partition that has come to the
    shallow depth is ordered by a blind trie.
    """
    data = np.r_[data, np.zeros(8, np.uint8)]
    char = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    n = len(start)
    shallow = min(shallow, width // 8 * 8)
    # Buckets of the first two bytes, by a radix sort; then quicksort within them.
    pair = (char[start] >> U(48)).astype(np.uint16)
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    cut = np.r_[True, pair[1:] != pair[:-1]] if n else np.zeros(0, bool)  # where a partition begins
    first = np.flatnonzero(cut)
    size, depth = np.diff(np.r_[first, n]), np.zeros(len(first), np.int64)
    while True:
        open_ = (size > 1) & (depth < shallow)
        first, size, depth = first[open_], size[open_], depth[open_]
        if not len(first):
            break
        few = size <= FEW
        if few.any():
            cut[_sort_few(char, start, order, first[few], size[few], shallow)] = True
            first, size, depth = first[~few], size[~few], depth[~few]
            if not len(first):
                break
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(owner)) + (first - begin)[owner]  # places of the open partitions, end to end
        c = char[start[order[at]] + depth[owner]].astype(U)
        pivot = _pivots(c, begin, size)[owner]
        side = (c >= pivot).astype(np.int8) + (c > pivot)
        held = np.bincount(owner * 3 + side, minlength=3 * len(size))
        begins = np.repeat(first - begin, 3) + np.cumsum(held) - held
        to = np.empty(len(owner), np.int64)
        for k in range(3):
            those = np.flatnonzero(side == k)
            of = owner[those]
            n_of = held[k::3]
            to[those] = begins[k::3][of] + np.arange(len(those)) - (np.cumsum(n_of) - n_of)[of]
        order[to] = order[at]
        depths = np.repeat(depth, 3) + 8 * (np.arange(3 * len(size)) % 3 == 1)
        some = held > 0
        first, size, depth = begins[some], held[some], depths[some]
        cut[first] = True
    group = np.cumsum(cut) - 1
    depth = shallow
    single = cut & np.r_[cut[1:], True] if n else cut
    open_ = np.flatnonzero(~single)
    if len(open_) and depth < width:  # blind tries for what still agrees
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        lead = start[order[head[group[open_]]]]
        own = start[order[open_]]
        differs = np.zeros(len(open_), bool)
        for d in [*range(depth, width - 7, 8), width - 8]:
            differs |= char[own + d] != char[lead + d]
        mixed = np.unique(group[open_[differs]])
        fresh = np.zeros(n, bool)
        fresh[head] = True
        size = np.diff(np.r_[head, n])
        raw = data.tobytes()
        for g in mixed:
            lo, hi = head[g], head[g] + size[g]
            trie = BlindTrie(width)
            for item in order[lo:hi].tolist():
                s = int(start[item])
                trie.add(raw[s : s + width], item)
            at = lo
            for items in trie.leaves():
                order[at : at + len(items)] = items
                fresh[at] = True
                at += len(items)
        group = np.cumsum(fresh) - 1
    return order, group


def unpacked(rows: pa.Table) -> np.ndarray:
    """The strings of all rows, end to end."""
    sizes = [int(np.frombuffer(x.as_buffer(), np.int32).sum()) for x in rows["lengths"]]
    pieces = [np.frombuffer(pa.decompress(x.as_buffer(), n, codec="zstd"), np.uint8) for x, n in zip(rows["bytes"], sizes, strict=True) if n]
    return np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)


def _settle(width: int, parts: int):
    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind = table["kind"].to_numpy()

        def values(name, k, dtype):
            column = table[name].filter(pa.array(kind == k)).combine_chunks()
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
            return ragged(column, dtype)[0] if len(column) else np.zeros(0, dtype)

        def sizes(name, k, width):
            column = table[name].filter(pa.array(kind == k))
            return ragged(pa.concat_arrays(column.chunks), f"V{width}")[1] if len(column) else np.zeros(0, np.int64)

        def owners(k):
            """rid and id of each string's document."""
            docs = values("docs", k, np.int32)
            tables, counts = [values(c, k, np.int64) for c in ("rids", "ids")], sizes("docs", k, 4)
            base = np.repeat(np.cumsum(sizes("rids", k, 8)) - sizes("rids", k, 8), counts)
            return tuple(t[docs + base] for t in tables)

        rid, ident = owners(ASKED)
        start, length = (values(c, ASKED, np.int32).astype(np.int64) for c in ("starts", "lengths"))
        data = unpacked(table.filter(pa.array(kind == ASKED)))
        place = np.cumsum(length) - length
        whole = settled_strings(data, place, length, ident) if len(place) else np.zeros(0, bool)
        known = (rid[whole], start[whole], start[whole] + length[whole])
        rid, ident, start, length, place = (x[~whole] for x in (rid, ident, start, length, place))
        windows = length - width + 1
        owner = np.repeat(np.arange(len(windows)), windows)
        inside = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        later = np.zeros(len(owner), bool)
        if len(owner):
            order, group = sort_suffixes(data, place[owner] + inside, width)
            members = np.bincount(group)
            least = np.minimum.reduceat(ident[owner[order]], np.cumsum(members) - members)
            later[order] = ident[owner[order]] > least[group]
        first, end = spans_of(later, owner)
        who = owner[first]
        settled = values("starts", SETTLED, np.int32).astype(np.int64)
        doc = np.concatenate([rid[who], known[0], owners(SETTLED)[0]])
        begin = np.concatenate([start[who] + inside[first], known[1], settled])
        stop = np.concatenate([start[who] + inside[end - 1] + width, known[2], settled + values("lengths", SETTLED, np.int32)])
        pairs = np.stack([begin, stop], axis=1).reshape(-1)
        return to_documents(np.repeat(doc, 2), pairs, parts)

    return settle


def _remove(batches):
    for batch in portions(batches):
        for chunk in chunks(batch.column("text"), 4 << 20):
            part = batch.slice(chunk.lo, chunk.rows)
            flat, counts = ragged(part.column("found"), np.int64)
            row = np.repeat(np.arange(chunk.rows), counts // 2)
            n = len(chunk.data)
            begin, end = flat[0::2] + chunk.offset[row], flat[1::2] + chunk.offset[row]
            step = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
            gone = np.cumsum(step[:n]) > 0
            touched = np.flatnonzero(gone)
            of = np.searchsorted(chunk.offset, touched, "right") - 1
            edge = np.r_[True, (touched[1:] != touched[:-1] + 1) | (of[1:] != of[:-1])] if len(touched) else np.zeros(0, bool)
            s, e = touched[edge], touched[np.r_[edge[1:], True]] + 1 if len(touched) else touched
            of = of[edge]
            removed = np.bincount(of, weights=e - s, minlength=chunk.rows).astype(np.int64)
            size = np.diff(chunk.offset)
            kept = slice_binary(chunk.data[~gone], np.r_[0, np.cumsum(size - removed)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), span_lists(s - chunk.offset[of], e - chunk.offset[of], of, chunk.rows), kept],
                names=["doc_id", "n_bytes", "n_removed", "removed", "kept"],
            )


#: Colliding names that are made anew one by one; were there more, all would be.
CLASHES = 1000


def _text_name(text, seed: int):
    return F.xxhash64(text, F.lit(seed))


def _named_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` with th, a 64-bit name of its text that no other text has; staged (rid, ident, th, digest); staged (digest, first: smallest ident).

    Names of different texts (by MD5) that collide are replaced until none does.
    """
    whole = F.coalesce("text", F.lit(""))
    name, seed = _text_name(whole, 0), 0
    while True:
        named = docs.withColumn("th", name)
        names = stage(named.select("rid", "ident", "th", F.md5(whole).alias("digest")))
        firsts = stage(names.groupBy("digest").agg(F.min("ident").alias("first"), F.first("th").alias("th")))  # staged: a join of plain scans can split a hot digest
        clashes = [r.th for r in firsts.groupBy("th").count().filter("count > 1").limit(CLASHES + 1).select("th").collect()]
        if not clashes:
            return named, names, firsts.drop("th")
        release(names, firsts)
        seed += 1
        other = _text_name(whole, seed)
        name = other if len(clashes) > CLASHES else F.when(name.isin(clashes), other).otherwise(name)


RESULT = "n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"


def remove_later(docs: DataFrame, width: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (maximal byte spans) and kept (bytes) of each row. Ids are integers."""
    if not GRAM + 8 <= width <= WIDEST:
        raise ValueError(f"a window has {GRAM + 8} to {WIDEST} bytes")
    kind = docs.schema[id_column].dataType.simpleString()
    docs = with_rid(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    docs, names, firsts = _named_texts(docs.withColumn("ident", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))))
    parts = parts_for(docs, part_bytes=PART_BYTES)
    named = docs.select("th", "text").mapInArrow(_name_minimizers(width, parts), PACKED_DDL)
    shared, hot = shared_keys(named, np.uint32, parts, distinct=True)
    later = names.join(firsts, "digest").select("rid", "th", (F.col("ident") > F.col("first")).alias("later"))
    asking = later.filter("not later").join(shared.withColumnRenamed("rid", "th"), "th").groupBy("rid").agg(F.first("found").alias("found"))
    known = later.filter("later").select("rid", F.lit(True).alias("later")).distinct().join(asking, "rid", "full")
    candidates = docs.select("rid", "ident", "text").join(known, "rid", "left").withColumn("later", F.coalesce("later", F.lit(False)))
    sent = candidates.mapInArrow(_send_strings(width, parts, hot), STRINGS_DDL)
    spans = stage(by_document(sent.groupBy("part").applyInArrow(then_give_back(_settle(width, parts)), PACKED_DDL), np.int64))
    release(names, firsts, shared)
    return docs.select("rid", "doc_id", "text").join(spans, "rid", "left").mapInArrow(_remove, f"doc_id {kind}, {RESULT}")
