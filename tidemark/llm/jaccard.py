"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct shingles of ``size`` words (A-Z lower-cased); with
fewer words the whole sequence is the one shingle; without words the set is empty and
links with nothing. Documents link when their Jaccard similarity is at least
``percent`` per cent. Documents with equal sets are one node of the link graph, named by
64 bits of their shingles.

PartEnum: sets fall into bands by size, such that linked sets are in one band or in
neighbouring ones; a set takes part in its own band and the next. For a band whose sets
differ in ``k`` shingles at most when linked, the domain is hashed to ``n1`` partitions
of three parts each. Some partition then holds at most one difference, so two of its
three parts agree: each pair of parts of each partition is a signature. A few spare
partitions let signatures without shingles be left out, but for a set that has more of
those than there are spares, so no link is lost.

Signatures meet in a shuffle of packed keys. Small groups give all their pairs; in
larger ones each member is paired with the group's hub, the member that shares most.
A group that a mapper finds large is paired with its hub there and sends only the hub
on, marked as such: whom the hub meets elsewhere counts as a member of a large group.
Pairs are refuted by size and by parity sketches (the sketches of two sets differ in no
more bits than the sets in shingles) and decided by exact intersection, for which a set
with many partners is sent once for each ``FAN`` of them.

Large groups that then still span several components are searched again, with other hubs
at first. What even then spans several is joined by prefixes: in an order of shingles that
puts those first that only one of the open groups' sets has, two linked sets have one in
common among their first ones; only sets that share such a shingle, and only across
components, become pairs. The components are
therefore those of all links; pairs inside a component are tested only as far as that
takes. Components are found by contraction: each task reduces its links to stars, nodes
with several roots link these, and the few links between roots are contracted again.

A null text has no words. Repeated rows and ties share a node. Null ids are ignored in
the choice of the smallest id. Texts of any length are handled whole, by one task. An
empty table gives an empty result. Extra columns are ignored, whatever their names. Ids
are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ANSWER, PACKED_DDL, QUESTION, WITNESS, Remembered, _rows, pack, part_of, parts_for, shared_keys, to_documents
from .storage import broadcast_if_small, has_ids, release, shuffle_width, stage, with_rid
from .textarrays import LOWER, WORD_SEPARATOR, U, chunks, give_back, mix, portions, ragged, rolling, slice_binary, then_give_back

WORD_SEED, SET_SEED = 41, 42
SKETCH_BITS, WIDE_BITS, WIDE_FROM = 1024, 8192, 800
ALL_PAIRS = 12
HUB = ANSWER  # kind of rows with hubs that stand for a large group of their mapper
LOCAL_HOT = 24
HUB_ROUNDS, PARTNER_ROUNDS = 1, 2
#: Partners for which a set is sent once; bytes of sets that are intersected together; links that are contracted together.
FAN, BUCKET_BYTES, CONTRACTED = 256, 16 << 20, 1 << 20
#: Text whose signatures a worker holds at a time.
PORTION_BYTES = 4 << 20
LOW32 = U(0xFFFFFFFF)


def shingle_sets(chunk, size: int):
    """Distinct shingles of each row: fingerprints in order of row and value, and their rows."""
    data = LOWER[chunk.data]
    start, end, row = chunk.words(WORD_SEPARATOR, data)
    word = chunk.fingerprints(start, end, WORD_SEED, data)
    n = len(word)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    last = np.searchsorted(row, row, "right")
    first = np.r_[True, row[1:] != row[:-1]]
    at = np.arange(n)
    use = np.flatnonzero((at + size <= last) | first)
    r = rolling(SET_SEED)
    stop = np.minimum(use + size, last[use])
    value = mix(r.slices(r.prefix(word), use, stop) + (stop - use).astype(U))
    row = row[use]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
    return value[fresh], row[fresh]


def sums(cell: np.ndarray, value: np.ndarray, cells: int) -> np.ndarray:
    """Sums modulo 2**64 by cell, exact through two float sums of 32 bits each."""
    low = np.bincount(cell, weights=(value & LOW32).astype(float), minlength=cells)
    high = np.bincount(cell, weights=(value >> U(32)).astype(float), minlength=cells)
    return low.astype(U) + (high.astype(U) << U(32))


def node_of(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and node (fingerprint of the set) of each row."""
    count = np.bincount(row, minlength=rows)
    return count, mix(sums(row, mix(value), rows) ^ mix(count.astype(U))).view(np.int64)


class Bands:
    """Size bands and their numbers of partitions for a threshold of ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent
        self.top = [1]

    def reach(self, size: int) -> np.ndarray:
        while self.top[-1] < size:
            self.top.append(max(self.top[-1] + 1, (self.top[-1] + 1) * 100 // self.percent))
        self.top.append((self.top[-1] + 1) * 100 // self.percent)
        return np.array(self.top)

    def of(self, sizes: np.ndarray):
        """For each size the band, and for its own and the next band: differences, partitions, spares."""
        top = self.reach(int(sizes.max(initial=1)))
        band = np.searchsorted(top, sizes)
        for step in (0, 1):
            differ = 2 * top[band + step] * (100 - self.percent) // (100 + self.percent)
            least = (differ + 2) // 2
            spare = 1 + least // 16
            yield band + step, differ, least + spare, spare


def signatures(value: np.ndarray, row: np.ndarray, rows: int, percent: int):
    """(key, row) of all signatures of the sets, own band and next."""
    sizes = np.bincount(row, minlength=rows)
    third = ((mix(value ^ U(0x2545F4914F6CDD1D)) >> U(20)) % U(3)).astype(np.int64)
    spread = mix(value)
    keys, owners = [], []
    for band, differ, partitions, spare in Bands(percent).of(sizes):
        active = (differ > 0) & (sizes > 0)
        partitions = np.where(active, partitions, 0)
        base = np.cumsum(partitions) - partitions
        keep = active[row]
        r = row[keep]
        part = ((value[keep] >> U(32)) * partitions[r].astype(U) >> U(32)).astype(np.int64)
        cells = int(partitions.sum())
        cell = (base[r] + part) * 3 + third[keep]
        total = sums(cell, spread[keep], 3 * cells).reshape(cells, 3)
        count = np.bincount(cell, minlength=3 * cells).reshape(cells, 3)
        owner = np.repeat(np.arange(rows), partitions)
        number = np.arange(cells) - base[owner]
        pairs = ((0, 1), (0, 2), (1, 2))
        empty = np.stack([count[:, a] + count[:, b] == 0 for a, b in pairs], axis=1)
        poor = np.bincount(owner, weights=empty.any(axis=1), minlength=rows) > spare
        for k, (a, b) in enumerate(pairs):
            take = ~empty[:, k] | poor[owner]
            label = mix((band[owner[take]].astype(U) << U(40)) + number[take].astype(U) * U(3) + U(k))
            keys.append(mix((total[take, a] + total[take, b]) ^ label))
            owners.append(owner[take])
    return np.concatenate(keys), np.concatenate(owners)


def parity(value: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Parity sketches, ``bits`` bits a row: each shingle flips one bit."""
    flips = np.bincount(row * bits + (value & U(bits - 1)).astype(np.int64), minlength=rows * bits)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(rows, bits // 64)


def lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
    """The rows of ``values`` as lists where ``present``, null elsewhere."""
    border = np.r_[0, np.cumsum(present * values.shape[1])].astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(border), pa.array(values.reshape(-1)))
    return pc.if_else(pa.array(present), made, pa.scalar(None, made.type)) if not present.all() else made


def _describe(size: int):
    def run(batches):
        for batch in portions(batches):
            for chunk in chunks(batch.column("text")):
                value, row = shingle_sets(chunk, size)
                count, node = node_of(value, row, chunk.rows)
                sketch = parity(value, row, chunk.rows, SKETCH_BITS)
                large = count >= WIDE_FROM
                keep = large[row]
                number = np.cumsum(large) - 1
                wide = parity(value[keep], number[row[keep]], int(large.sum()), WIDE_BITS)
                part = batch.slice(chunk.lo, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("rid"), pa.array(count, pa.int64()), pa.array(node, pa.int64(), mask=count == 0), lists(sketch, np.ones(chunk.rows, bool)), lists(wide, large)],
                    names=["doc_id", "rid", "n_shingles", "node", "sketch", "wide"],
                )

    return run


def _send_signatures(size: int, percent: int, parts: int):
    def run(batches):
        for batch in portions(batches, limit=PORTION_BYTES):
            keys, owners = [], []
            seen: set[int] = set()
            for chunk in chunks(batch.column("text")):
                value, row = shingle_sets(chunk, size)
                if not len(value):
                    continue
                count, node = node_of(value, row, chunk.rows)
                new = np.zeros(chunk.rows, bool)
                for i in np.flatnonzero(count):
                    if (n := int(node[i])) not in seen:
                        seen.add(n)
                        new[i] = True
                keep = new[row]
                key, owner = signatures(value[keep], row[keep], chunk.rows, percent)
                keys.append(key)
                owners.append(node[owner])
            if not keys:
                continue
            key, node = np.concatenate(keys), np.concatenate(owners)
            nodes, at = np.unique(node, return_inverse=True)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]] if len(order) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            hot = (np.bincount(group) > LOCAL_HOT)[group] if len(order) else new
            part = part_of(key, parts)
            for kind, send in ((QUESTION, order[~hot]), (HUB, order[hot & new])):
                if len(send):
                    yield _rows(kind, part[send], at[send], (key[send] & LOW32).astype(np.uint32), nodes)
            if hot.any():
                hub = order[np.flatnonzero(new)[group]]
                member, hub = order[hot], hub[hot]
                sig = ((part[member].astype(U) << U(32)) | (key[member] & LOW32)).view(np.int64)
                to = part_of(mix(nodes.astype(U)), parts)[at[member]]
                for values in (np.stack([node[hub], sig], axis=1), np.stack([node[member], sig], axis=1)):
                    by = np.lexsort((at[member], to))
                    yield _pairs_rows(to[by], at[member][by], values[by], nodes)

    return run


def _pairs_rows(part, doc, values, nodes) -> pa.RecordBatch:
    """Rows of kind WITNESS that carry (other, signature) for each ``doc``; sorted by part and doc."""
    n = len(part)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    one = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])
    by = np.r_[np.searchsorted(one, at), len(one)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[at].astype(np.int32)),
            pa.array(np.full(len(at), WITNESS, np.int8)),
            slice_binary(nodes[doc[one]], by),
            slice_binary((2 * np.diff(np.r_[one, n])).astype(np.int32), by),
            slice_binary(np.ascontiguousarray(values).reshape(-1), 2 * np.r_[at, n]),
        ],
        names=["part", "kind", "docs", "counts", "keys"],
    )


def _pair_up(parts: int):
    """Candidate pairs of a part: (u, v, signature); v = u marks a member of a large group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind = table["kind"].to_numpy()
        own = int(table["part"][0].as_py())

        def values(name, k, dtype):
            column = table[name].filter(pa.array(kind == k))
            return ragged(pa.concat_arrays(column.chunks), dtype)[0] if len(column) else np.zeros(0, dtype)

        sides = [(values("keys", k, np.uint32), np.repeat(values("docs", k, np.int64), values("counts", k, np.int32))) for k in (QUESTION, HUB)]
        key, node = (np.concatenate(x) for x in zip(*sides, strict=True))
        met = np.isin(key, sides[1][0])  # the key's group is large in some mapper
        order = np.lexsort((node, key))
        key, node, met = key[order], node[order], met[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
        key, node, met = key[fresh], node[fresh], met[fresh]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        size = np.bincount(group) if len(key) else np.zeros(0, np.int64)
        shared = size[group] > 1 if len(key) else new
        key, node, met, size_of = key[shared], node[shared], met[shared], size[group][shared] if len(key) else size
        found = [(np.zeros(0, np.int64),) * 3]
        for step in range(1, ALL_PAIRS):  # pairs of members that far apart, in all small groups at once
            a = np.flatnonzero((key[step:] == key[:-step]) & (size_of[step:] <= ALL_PAIRS)) if len(key) > step else np.zeros(0, np.int64)
            found.append((node[a], node[a + step], np.zeros(len(a), np.int64)))
        small = met & (size_of <= ALL_PAIRS)
        found.append((node[small], node[small], (np.int64(own) << 32) | key[small].astype(np.int64)))
        large = size_of > ALL_PAIRS
        if large.any():
            k, n = key[large], node[large]
            names, at = np.unique(n, return_inverse=True)
            degree = np.bincount(at)[at]
            best = np.lexsort((n, -degree, k))
            head = np.flatnonzero(np.r_[True, k[best][1:] != k[best][:-1]])
            hub = np.repeat(n[best][head], np.diff(np.r_[head, len(k)]))
            member = n[best]
            sig = ((np.int64(own) << 32) | k[best].astype(np.int64))
            other = member != hub
            found.append((member[other], hub[other], sig[other]))
            found.append((member, member, sig))
        u, v, sig = (np.concatenate(x) for x in zip(*found, strict=True))
        settled = values("keys", WITNESS, np.int64)
        if len(settled):
            u = np.concatenate([u, np.repeat(values("docs", WITNESS, np.int64), values("counts", WITNESS, np.int32) // 2)])
            v, sig = np.concatenate([v, settled[0::2]]), np.concatenate([sig, settled[1::2]])
        u, v = np.minimum(u, v), np.maximum(u, v)
        sig = np.where(u == v, sig, 0)
        order = np.lexsort((sig, v, u))
        u, v, sig = u[order], v[order], sig[order]
        fresh = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (sig[1:] != sig[:-1])] if len(u) else np.zeros(0, bool)
        u, v, sig = u[fresh], v[fresh], sig[fresh]
        return to_documents(np.repeat(u, 2), np.stack([v, sig], axis=1).reshape(-1), parts)

    return run


def _unpack_pairs(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    column = lambda name: pa.concat_arrays(table[name].chunks)
    u = np.repeat(ragged(column("docs"), np.int64)[0], ragged(column("counts"), np.int32)[0] // 2)
    values = ragged(column("keys"), np.int64)[0]
    rows = np.unique(np.stack([u, values[0::2], values[1::2]], axis=1), axis=0) if len(u) else np.zeros((0, 3), np.int64)
    return pa.table({"u": rows[:, 0], "v": rows[:, 1], "sig": rows[:, 2]})


def _sets(size: int):
    def run(batches):
        for batch in portions(batches):
            for chunk in chunks(batch.column("text")):
                value, row = shingle_sets(chunk, size)
                part = batch.slice(chunk.lo, chunk.rows)
                yield pa.RecordBatch.from_arrays([part.column("node"), slice_binary(value, np.searchsorted(row, np.arange(chunk.rows + 1)))], names=["node", "set"])

    return run


def _intersect(percent: int):
    """Links among the rows of a bucket: a set (member null) and the sets of some of its partners."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        alone = table["member"].is_null()
        heads, rest = table.filter(alone), table.filter(pc.invert(alone))
        held = {h: np.frombuffer(x.as_buffer(), U) for h, x in zip(heads["hub"].to_pylist(), heads["set"], strict=True)}
        hub, member = (rest[c].to_numpy() for c in ("hub", "member"))
        chunks_ = rest["set"].chunks
        flat, counts = ragged(pa.concat_arrays(chunks_), U) if chunks_ else (np.zeros(0, U), np.zeros(0, np.int64))
        end = np.cumsum(counts)
        linked = np.zeros(len(hub), bool)
        order = np.argsort(hub, kind="stable")
        head = np.flatnonzero(np.r_[True, hub[order][1:] != hub[order][:-1]]) if len(hub) else order
        for lo, hi in zip(head, np.r_[head[1:], len(order)], strict=True):
            own = held[int(hub[order[lo]])]
            for i in np.array_split(order[lo:hi], 1 + int(counts[order[lo:hi]].sum()) // CONTRACTED):
                if not len(i):
                    continue
                n = counts[i]
                begin = np.cumsum(n) - n
                values = flat[np.repeat(end[i] - n - begin, n) + np.arange(int(n.sum()))]
                both = np.add.reduceat(own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values, begin, dtype=np.int64)
                linked[i] = 100 * both >= percent * (len(own) + n - both)
        return pa.table({"u": np.minimum(hub, member)[linked], "v": np.maximum(hub, member)[linked]})

    return run


SKETCHED = ("n", "sketch", "wide")


def _side(info: DataFrame, side: str) -> DataFrame:
    return info.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in SKETCHED])


def _plausible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and sketches do not refute."""
    return pairs.join(_side(info, "u"), "u").join(_side(info, "v"), "v").filter(_may_link(percent)).select("u", "v")


def _may_link(percent: int):
    flipped = lambda s: F.aggregate(F.zip_with(f"{s}_u", f"{s}_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    apart = F.when(F.col("wide_u").isNotNull() & F.col("wide_v").isNotNull(), flipped("wide")).otherwise(flipped("sketch"))
    sizes = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col("n_u") + F.col("n_v")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs``, by exact intersection.

    Of each pair the one with more partners is the hub; its set goes once to each ``FAN`` of them.
    """
    both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select("v", "u"))
    degree = broadcast_if_small(both.groupBy("x").agg(F.count("*").alias("d")))
    at = lambda side: degree.select(F.col("x").alias(side), F.col("d").alias(f"d_{side}"))
    known = pairs.join(at("u"), "u").join(at("v"), "v")
    high = F.col("d_u") > F.col("d_v")
    rows = known.select(F.when(high, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(high, F.col("v")).otherwise(F.col("u")).alias("member"), F.greatest("d_u", "d_v").alias("d"))
    rows = broadcast_if_small(rows.withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("d") / FAN))).drop("d"))
    whole = rows.join(sets.select(F.col("node").alias("member"), "n"), "member").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(shuffle_width(pairs.sparkSession), 1 + 8 * whole // BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64("hub", "salt"), F.lit(buckets)).cast("int").alias("bucket")
    members = rows.join(sets.select(F.col("node").alias("member"), "set"), "member").select(bucket, "hub", "member", "set")
    hubs = broadcast_if_small(rows.select("hub", "salt").distinct()).join(sets.select(F.col("node").alias("hub"), "set"), "hub").select(bucket, "hub", F.lit(None).cast("long").alias("member"), "set")
    return members.unionAll(hubs).groupBy("bucket").applyInArrow(then_give_back(_intersect(percent)), "u long, v long")


def local_components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the least node of each one's component."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        while (after != after[after]).any():
            after = after[after]
        if (after == label).all():
            return names, names[label]
        label = after


def _contract(batches):
    """Links as stars: (least node, node) for each node of a component of the task's links, some at a time."""
    held, size = [], 0

    def stars():
        nodes, roots = local_components(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(roots), pa.array(nodes)], names=["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("u", "v")))
        size += batch.num_rows
        if size >= CONTRACTED:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()
    give_back()


def components(links: DataFrame) -> DataFrame:
    """Staged (node, label) of every node with a link: least node of its component."""
    stars = stage(links.select("u", "v").mapInArrow(_contract, "u long, v long"))
    least = stage(stars.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"), F.max("u").alias("other")))
    torn = least.filter("label != other").select(F.col("node").alias("v"), "label")
    between = stage(stars.join(torn, "v").filter("u != label").select(F.col("label").alias("u"), F.col("u").alias("v")).distinct())
    if between.isEmpty():
        return least.select("node", "label")
    up = components(between).select(F.col("node").alias("label"), F.col("label").alias("root"))
    labels = stage(least.select("node", "label").join(up, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
    release(stars, least, between)
    return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Staged labels after more links: only components that these join are worked on."""
    if labels is None:
        return components(links)
    at = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}"))
    ends = links.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("l_u", "u").alias("u"), F.coalesce("l_v", "v").alias("v"))
    up = components(stage(ends.filter("u != v").distinct()))
    old = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return stage(old.unionAll(up.join(labels.select("node"), "node", "left_anti")))


def _settle_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links among ``pairs`` that span the components of all of them, and the components' labels.

    At first each node is compared with the partner that has most pairs, so in a round a
    set travels once; pairs that then lie within a component need no test.
    """
    links, labels = None, None
    for turn in range(PARTNER_ROUNDS + 1):
        if turn < PARTNER_ROUNDS:
            both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select("v", "u"))
            degree = broadcast_if_small(both.groupBy(F.col("x").alias("y")).agg(F.count("*").alias("d")))
            best = both.join(degree, "y").groupBy("x").agg(F.max_by("y", F.struct(F.col("d"), -F.col("y"))).alias("y"))
            picked = stage(best.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        else:
            picked = pairs
        found = stage(_verified(picked, sets, percent))
        links = found if links is None else links.union(found)
        labels = merged(labels, found)
        if turn == PARTNER_ROUNDS:
            break
        at = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}"))
        rest = pairs.join(picked, ["u", "v"], "left_anti").join(at("u"), "u", "left").join(at("v"), "v", "left")
        pairs = stage(rest.filter(~F.coalesce(F.col("l_u") == F.col("l_v"), F.lit(False))).select("u", "v"))
        if pairs.isEmpty():
            break
    return links, labels


def _pack_shingles(parts: int):
    """The shingles of sets as packed keys, for the question which of them another set has."""

    def run(batches):
        sent = Remembered()
        for batch in portions(batches, "set"):
            flat, counts = ragged(batch.column("set"), U)
            key = mix(flat)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            yield from pack(part_of(key, parts), key.astype(np.uint32), owner, batch.column("node").to_numpy(), parts, False, sent)

    return run


def _first_keys(percent: int):
    """The least keys of each set's shared shingles that its prefix holds: the shingles without a partner go first."""

    def run(batches):
        for batch in batches:
            flat, shared = ragged(batch.column("found"), np.uint32)
            n = batch.column("n").to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), shared)
            order = np.lexsort((flat, owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(shared) - shared, shared)
            take = n - (n * percent + 99) // 100 + 1 - (n - shared)
            keep = place < take[owner]
            yield pa.RecordBatch.from_arrays([pa.array(flat[order][keep].astype(np.int64)), batch.column("node").take(pa.array(owner[keep]))], names=["shingle", "node"])
        give_back()

    return run


def _prefixes(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(shingle, node): of each node's set the first shingles in an order that all share, of which linked sets have one in common.

    Shingles that no other of the sets has come first, then the others by their key of 32
    bits, which stands for the shingle: two of one key only make a pair more to look at.
    """
    some = sets.join(broadcast_if_small(nodes), "node", "left_semi")
    total = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(shuffle_width(sets.sparkSession), 1 + 8 * total // BUCKET_BYTES)
    packed = some.select("node", "set").mapInArrow(_pack_shingles(parts), PACKED_DDL)
    found, _ = shared_keys(packed, np.uint32, parts)
    found = found.withColumnRenamed("rid", "node").join(sets.select("node", "n"), "node")
    return found.select("node", "n", "found").mapInArrow(_first_keys(percent), "shingle long, node long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged (node, sig, label) of the large groups that span several components."""
    rows = _labelled(members.select("node", "sig"), labels)
    split = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("sig")
    return stage(rows.join(broadcast_if_small(split), "sig", "left_semi"))


def _across(one: DataFrame, other: DataFrame, key: str, condition, percent: int) -> DataFrame:
    """Plausible pairs (u, v) of rows of ``one`` and ``other`` (key, node, label, sketches) that share the key."""
    named = lambda rows, side: rows.select(key, *[F.col(c).alias(f"{d}_{side}") for c, d in zip(("node", "label", *SKETCHED), ("id", "l", *SKETCHED), strict=True)])
    met = named(one, "u").join(named(other, "v"), key).filter(condition & _may_link(percent))
    return met.select(F.least("id_u", "id_v").alias("u"), F.greatest("id_u", "id_v").alias("v")).distinct()


def _close_groups(members: DataFrame, tested: DataFrame, links: DataFrame, labels: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels after the links that large groups hold across components."""
    for turn in range(HUB_ROUNDS + 1):
        members = _open_groups(members, labels)
        if members.isEmpty():
            break
        rows = members.join(info.select("node", *SKETCHED), "node")
        if turn < HUB_ROUNDS:
            degree = links.select(F.col("u").alias("node")).union(links.select("v")).groupBy("node").agg(F.count("*").alias("degree"))
            rank = F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.xxhash64("node", F.lit(turn)).alias("draw"))
            hubs = rows.join(degree, "node", "left").groupBy("sig").agg(F.max_by(F.struct("node", "label", *SKETCHED), rank).alias("hub")).select("sig", "hub.*")
            more = _across(rows, hubs, "sig", F.col("l_u") != F.col("l_v"), percent)
        else:
            nodes = stage(members.select("node", "label").distinct())
            prefixes = stage(_prefixes(sets, nodes.select("node"), percent).join(nodes, "node").distinct())
            split = prefixes.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("shingle")
            prefixes = prefixes.join(broadcast_if_small(split), "shingle", "left_semi").join(info.select("node", *SKETCHED), "node")
            more = _across(prefixes, prefixes, "shingle", F.col("l_u") < F.col("l_v"), percent)
        more = stage(more.join(tested, ["u", "v"], "left_anti"))
        tested = tested.union(more)
        fresh = stage(_verified(more, sets, percent))
        if not fresh.isEmpty():
            links = links.union(fresh)
            labels = merged(labels, fresh)
    return labels


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """What :func:`classes` returns, and the staged tables that it reads."""
    plain = has_ids(docs)
    docs = with_rid(docs, plain)
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = stage(docs.mapInArrow(_describe(size), f"doc_id {kind}, rid long, n_shingles long, node long, sketch array<long>, wide array<long>"))
    info = described.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("rid").alias("rid"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    info = stage(info)
    nodes = stage(described.select("doc_id", "rid", "n_shingles", "node"))
    release(described)
    parts = parts_for(docs)
    sent = docs.select("text").mapInArrow(_send_signatures(size, percent, parts), PACKED_DDL)
    paired = sent.groupBy("part").applyInArrow(then_give_back(_pair_up(parts)), PACKED_DDL)
    found = stage(paired.groupBy("part").applyInArrow(then_give_back(_unpack_pairs), "u long, v long, sig long"))
    members = found.filter("u = v").select(F.col("u").alias("node"), "sig")
    tested = stage(_plausible(found.filter("u != v").select("u", "v").distinct(), info, percent))
    needed = tested.select(F.col("u").alias("node")).union(tested.select("v")).union(members.select("node")).distinct()
    needed = broadcast_if_small(needed.join(info, "node").select("rid", "node"))
    sets = docs.select("rid", "text").join(needed, "rid").select("node", "text").mapInArrow(_sets(size), "node long, set binary")
    sets = sets if plain else sets.groupBy("node").agg(F.first("set").alias("set"))  # rows may share a name
    sets = stage(sets.withColumn("n", (F.octet_length("set") / 8).cast("long")), "none")
    links, labels = _settle_pairs(tested, sets, percent)
    labels = _close_groups(members, tested, links, labels, info, sets, percent)
    labelled = _labelled(info.select("node", "first"), labels)
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    where = stage(labelled.join(smallest, "label").select("node", "label", "component_id"))
    release(info, found, tested, sets)
    out = nodes.join(where, "node", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id")).select("doc_id", "rid", "n_shingles", "node", "label", "component_id"), [nodes, where]


def classes(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, rid, n_shingles, node, label and component_id of each row of ``docs``.

    component_id is the smallest doc_id reachable by links, itself included; label names
    the component (null for a row without words); rid is the id itself, or a hash of id
    and text where ids repeat or are null.
    """
    return _classes(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), size, percent)[0]


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, all columns: that of the smallest doc_id (a null id comes last).

    Rows without words all stay. Of rows that repeat the kept one in id and text, one stays.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found, held = _classes(docs.select("doc_id", "text"), size, percent)
    marked = stage(found.filter("node is not null").select("doc_id", "rid", "label"))
    release(*held)
    best = stage(marked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("best")).select(F.col("best.rid").alias("rid")))
    drop = marked.select("rid").distinct().join(best, "rid", "left_anti")
    twice = stage(marked.groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1").select("rid").join(best, "rid", "left_semi"))
    names = with_rid(docs.select("doc_id", "text", row)).select("rid", "row")
    kept = names.join(broadcast_if_small(drop.union(twice)), "rid", "left_anti").select("row")
    if not twice.isEmpty():  # rows that repeat a kept row
        again = names.join(broadcast_if_small(twice), "rid", "left_semi").groupBy("rid").agg(F.first("row").alias("row"))
        kept = kept.unionAll(again.select("row"))
    return kept.select("row.*")
