"""Hard negatives by a Voronoi-partitioned kNN join on inner products.

Vectors become whole numbers. Every row gets one more coordinate, which makes all rows
equally long (M, the greatest length), and anchors get a 0 there; then the row of greater
inner product with an anchor is the nearer one. Rows are assigned to the cell of their
nearest pivot, anchors to a group of neighbouring cells of ``GROUP_ANCHORS`` at most (a
cell with more is split).

1. A local join of each group with its own cells finds, for each anchor, how far its
   positives are at most.
2. From that and from the distances of a group's anchors to each pivot follows, by the
   triangle inequality, which distances from its pivot a row of a cell must have to serve
   the group. Rows are copied to those groups only (:func:`reach`), and the exact join
   within the groups finds the positives.
3. The positives' scores bound the scores of negatives; again rows go only to the groups
   that their bounds allow, and an exact join finds the negatives.

Groups are joined in parts of ``PART_ROWS`` rows, dealt by a hash of the row, so a cell that
holds a third of all rows is no heavier than others; a part streams its rows past the
group's anchors and keeps the best few. All results are exact; pivots (``PIVOTS`` at most,
from a hash order) only decide what is copied. In many dimensions bounds rule out little;
then each group meets nearly all rows, in parts, as an exact join has to.

Rows with a null id, label or vector, or with a component that is null or not finite (also
once scaled), take no part. Shorter vectors are filled up with zeros. Where an id occurs in
several rows, the one with the least label and then vector counts. Scores beyond 2**56 are
set to that. An empty table gives an empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, release, shuffle_width, stage
from .textarrays import give_back

PIVOTS, GROUP_ANCHORS, PART_ROWS = 256, 1024, 1 << 16
#: Cells of a matrix of scores that a task holds at a time.
TILE = 1 << 21
CLIP = 1 << 56
#: Stands for the score of a row that is out of the question.
NEVER = -(1 << 62)


def usable(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v: floor of the scaled components) of the rows that take part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) == float("inf")))
    # floor() of a double is a long: beyond that range doubles are whole anyway.
    v = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**62, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    kept = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(~odd)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))


class Space(NamedTuple):
    """Number of dimensions, greatest component, square of the greatest length in units of that, and whether doubles hold all scores exactly."""

    dim: int
    unit: float
    square: float
    exact: bool


def _space(rows: DataFrame) -> Space:
    longest, unit = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    unit = max(unit or 0.0, 1.0)
    square = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit)))).first()[0] or 0.0
    dim = max(longest or 0, 1)
    return Space(dim, unit, square, dim * unit * unit < 2.0**53)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """One row per vector, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _lengthened(v: np.ndarray, space: Space, anchor: bool = False) -> np.ndarray:
    """In units of the greatest component, with the coordinate that makes rows equally long (0 for anchors)."""
    v = v / space.unit
    rest = np.zeros(len(v)) if anchor else np.sqrt(np.maximum(space.square - np.einsum("ij,ij->i", v, v), 0.0))
    return np.column_stack([v, rest])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _slack(space: Space) -> float:
    """More than rounding can shift a distance."""
    return 1e-6 * np.sqrt(space.dim + 1.0)


def _scores(a: np.ndarray, b: np.ndarray, space: Space) -> np.ndarray:
    """Integer inner products, exact, up to CLIP."""
    if space.exact:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([int(x) for x in m.ravel()], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -CLIP, CLIP).astype(np.int64)


def pick_pivots(rows: DataFrame, space: Space, number: int) -> np.ndarray:
    """Distinct rows that come first in a hash order: a sample of ``number`` rows at most."""
    some = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(number).select("v").toArrow()
    column = some["v"].combine_chunks()
    return np.unique(_lengthened(_matrix(column, space.dim), space), axis=0)


def _assign(pivots: np.ndarray, space: Space, anchors: bool):
    def run(batches):
        for batch in batches:
            v = _lengthened(_matrix(batch.column("v"), space.dim), space, anchors)
            cell, near = np.zeros(len(v), np.int32), np.zeros(len(v))
            step = max(1, TILE // len(pivots))
            for lo in range(0, len(v), step):
                d = _distances(v[lo : lo + step], pivots)
                cell[lo : lo + step] = d.argmin(1)
                near[lo : lo + step] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], names=[*batch.schema.names, "cell", "d"])
        give_back()

    return run


ROW = "vec_id long, label long, v array<double>, cell int, d double"


def assigned(rows: DataFrame, pivots: np.ndarray, space: Space, anchors: bool = False) -> DataFrame:
    """Adds cell, the nearest pivot, and d, the distance to it."""
    return rows.select("vec_id", "label", "v").mapInArrow(_assign(pivots, space, anchors), ROW)


def chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which neighbours are near: from each to the nearest one left."""
    left, order = np.ones(len(pivots), bool), [0]
    left[0] = False
    between = _distances(pivots, pivots)
    while left.any():
        order.append(int(np.where(left, between[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return order


def cell_groups(counts: dict[int, int], pivots: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """First group and number of groups of each cell that has anchors: neighbouring cells share a group of ``most`` anchors, a cell with more has several."""
    out, group, held = {}, 0, 0
    for cell in chain(pivots):
        n = counts.get(cell, 0)
        if not n:
            continue
        if held and held + n > most:
            group, held = group + 1, 0
        split = -(-n // most)
        out[cell] = (group, split)
        held += n
        if split > 1:
            group, held = group + split, 0
    return out


def _looked_up(spark, table: dict[int, tuple[int, int]]) -> DataFrame:
    """(cell, first, split), one row per pivot at most."""
    return F.broadcast(spark.createDataFrame([(c, *x) for c, x in table.items()], "cell int, first int, split int"))


def reach(windows: DataFrame, pivots: np.ndarray, space: Space) -> DataFrame:
    """(cell, group, least, most): the distances from its pivot that a row of the cell must have to serve the group.

    ``windows`` has grp, v, near and far of each anchor: it is served by rows at distances
    in [near, far] (in the lengthened space). Rows of other distances from their pivot are
    too far or too near for each of the group's anchors, by the triangle inequality.
    """
    slack = _slack(space)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            near, far, grp = (batch.column(c).to_numpy() for c in ("near", "far", "grp"))
            to = _distances(_lengthened(_matrix(batch.column("v"), space.dim), space, True), pivots)
            least = np.maximum(to - far[:, None], near[:, None] - to) - slack
            most = to + far[:, None] + slack
            for g in np.unique(grp):
                a, b = least[grp == g].min(0), most[grp == g].max(0)
                if g in held:
                    a, b = np.minimum(a, held[g][0]), np.maximum(b, held[g][1])
                held[int(g)] = a, b
        for g, (a, b) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a), dtype=np.int32)), pa.array(np.full(len(a), g, np.int32)), pa.array(a), pa.array(b)], names=["cell", "grp", "least", "most"])
        give_back()

    each = windows.select("grp", "v", "near", "far").mapInArrow(bounds, "cell int, grp int, least double, most double")
    return each.groupBy("cell", "grp").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest scores of each row, ties by the smaller id."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        i, j = np.nonzero((score >= least) & (score > NEVER))
    else:
        i, j = np.nonzero(score > NEVER)
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


class _Kept:
    """The k best rows so far for each slot (an anchor, or an anchor and positive)."""

    def __init__(self, k: int):
        self.k, self.slot, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, slot, ids, score) -> None:
        slot, ids, score = np.r_[self.slot, slot], np.r_[self.id, ids], np.r_[self.score, score]
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.k
        self.slot, self.id, self.score = slot[keep], ids[keep], score[keep]


def _local_join(space: Space, k: int, low: int | None, high: int):
    """Rows sorted by (grp, part, kind): each part's anchors (kind 0), then the rows that may serve them.

    low None: the k best rows of the anchor's label. Else, for each score in ``caps``, the k
    best of other labels with low * cap <= 100 * score <= high * cap.
    """
    names = ["anchor_id", "cap", "vec_id", "score"]

    def run(batches):
        key, anchors, kept = None, None, None

        def flush():
            if kept is not None and len(kept.slot):
                yield pa.RecordBatch.from_arrays([pa.array(anchors["slot_id"][kept.slot]), pa.array(anchors["cap"][kept.slot]), pa.array(kept.id), pa.array(kept.score)], names=names)

        def opened(pieces: list[pa.RecordBatch]) -> dict:
            table = pa.Table.from_batches(pieces)
            v = _matrix(table["v"].combine_chunks(), space.dim)
            ids, label = table["vec_id"].to_numpy(), table["label"].to_numpy()
            if low is None:
                owner, cap = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            else:
                caps = table["caps"].combine_chunks()
                owner, cap = np.repeat(np.arange(len(ids)), np.diff(caps.offsets.to_numpy())), caps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            return {"v": v, "id": ids, "label": label, "owner": owner, "cap": cap, "slot_id": ids[owner]}

        def met(rows: pa.RecordBatch) -> None:
            ids, label, v = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"), space.dim)
            step = max(1, TILE // max(1, len(ids)))
            for lo in range(0, len(anchors["owner"]), step):
                some = slice(lo, lo + step)
                owner = anchors["owner"][some]
                who, back = np.unique(owner, return_inverse=True)
                score = _scores(anchors["v"][who], v, space)
                same = anchors["label"][who][:, None] == label
                if low is None:
                    score = np.where(same & (anchors["id"][who][:, None] != ids), score, NEVER)[back]
                else:
                    score, other, cap = score[back], ~same[back], anchors["cap"][some, None]
                    score = np.where(other & (low * cap <= 100 * score) & (100 * score <= high * cap), score, NEVER)
                i, j = _best(score, ids, k)
                kept.add(lo + i, ids[j], score[i, j])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            grp, part, kind = (batch.column(c).to_numpy() for c in ("grp", "part", "kind"))
            edges = np.flatnonzero(np.r_[True, (np.diff(grp) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)]) if len(grp) else []
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                here, piece = (int(grp[lo]), int(part[lo])), batch.slice(lo, hi - lo)
                if here != key:
                    yield from flush()
                    key, anchors, kept, waiting = here, None, None, []
                if kind[lo] == 0:
                    waiting.append(piece)
                elif waiting or anchors is not None:
                    if anchors is None:
                        anchors, kept, waiting = opened(waiting), _Kept(k), []
                    met(piece)
        yield from flush()
        give_back()

    return run


def local_join(anchors: DataFrame, copies: DataFrame, space: Space, k: int, low: int | None = None, high: int = 100, part_rows: int = PART_ROWS) -> DataFrame:
    """(anchor_id, cap, vec_id, score): for each group's anchors the best among the rows copied to the group, k from each part of it.

    ``anchors``: grp, vec_id, label, v, caps; ``copies``: grp, vec_id, label, v.
    """
    spark, width = copies.sparkSession, shuffle_width(copies.sparkSession)
    sizes = copies.groupBy("grp").agg(F.count("*").alias("n"))
    groups = max(1, sizes.count())
    # Enough parts for all tasks, and none of many more than part_rows rows.
    parts = sizes.select("grp", F.greatest(F.lit(-(-width // groups)), F.ceil(F.col("n") / part_rows)).cast("int").alias("parts"))
    parts = stage(parts)
    total = parts.agg(F.sum("parts")).first()[0] or 1
    small = F.broadcast(parts) if groups <= BROADCAST_ROWS else parts
    caps = F.lit(None).cast("array<long>")
    rows = copies.join(small, "grp").select("grp", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "vec_id", "label", "v", caps.alias("caps"))
    ask = anchors.join(small, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "vec_id", "label", "v", F.col("caps") if "caps" in anchors.columns else caps.alias("caps"))
    dealt = ask.unionByName(rows).repartition(max(width, total), "grp", "part").sortWithinPartitions("grp", "part", "kind")
    found = stage(dealt.mapInArrow(_local_join(space, k, low, high), "anchor_id long, cap long, vec_id long, score long"))
    release(parts)
    return found


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _unique(rows: DataFrame) -> DataFrame:
    """One row per id: where ids repeat, the least label and vector."""
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows
    least = F.min(F.struct("label", "v")).alias("x")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "x.label", "x.v")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int = PIVOTS, group_anchors: int = GROUP_ANCHORS, part_rows: int = PART_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from :func:`usable` rows.

    For each anchor and each of its ``positives`` best other rows of its label: the
    ``negatives`` best rows of other labels whose score is ``low`` to ``high`` hundredths
    of the positive's. Ties by the smaller id.
    """
    spark = rows.sparkSession
    rows = stage(_unique(stage(rows)))
    space = _space(rows)
    centres = pick_pivots(rows, space, pivots)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not len(centres):
        return empty
    placed = stage(assigned(rows, centres, space))
    homes = stage(assigned(rows.filter(is_anchor), centres, space, True))
    counts = {r.cell: r["count"] for r in homes.groupBy("cell").count().collect()}
    if not counts:
        return empty
    groups = cell_groups(counts, centres, group_anchors)
    lookup = _looked_up(spark, groups)
    grp = (F.col("first") + F.pmod(F.xxhash64("vec_id"), "split")).cast("int")
    anchors = stage(homes.join(lookup, "cell").select(grp.alias("grp"), "vec_id", "label", "v"))

    # How far each anchor's positives are at most: the join with its own group's cells.
    own = placed.join(lookup, "cell").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("split") - 1)).alias("grp"), "vec_id", "label", "v")
    near = local_join(anchors, own, space, positives, part_rows=part_rows)
    known = _top(near, ["anchor_id"], positives).groupBy("anchor_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / space.unit) * (x / space.unit))
    distance = lambda score: F.sqrt(F.greatest(F.lit(0.0), square + F.lit(space.square) - 2.0 * score / (space.unit * space.unit)))
    far = F.when(F.coalesce("n", F.lit(0)) >= positives, distance(F.col("least"))).otherwise(float("inf"))
    if not space.exact:
        far = F.lit(float("inf"))  # scores may be clipped
    windows = anchors.join(known, F.col("vec_id") == F.col("anchor_id"), "left").select("grp", "v", F.lit(0.0).alias("near"), far.alias("far"))
    found = local_join(anchors, _copied(placed, reach(windows, centres, space)), space, positives, part_rows=part_rows)
    best = stage(_top(found, ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # Negatives lie between the least allowed score and the greatest.
    caps = best.filter("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("caps"))
    capped = stage(anchors.join(caps, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))
    if space.exact:
        bounds = [distance(F.array_max("caps") * (high / 100.0)).alias("near"), distance(F.array_min("caps") * (low / 100.0)).alias("far")]
    else:
        bounds = [F.lit(0.0).alias("near"), F.lit(float("inf")).alias("far")]
    served = local_join(capped, _copied(placed, reach(capped.select("grp", "v", *bounds), centres, space)), space, negatives, low, high, part_rows)
    ranked = _top(served, ["anchor_id", "cap"], negatives).select("anchor_id", F.col("cap").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = stage(best.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    release(rows, placed, homes, anchors, near, found, best, capped, served)
    return out


def _copied(placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rows, once for each group that they might serve."""
    bounds = stage(bounds)
    small = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds
    return placed.join(small, (placed["cell"] == small["cell"]) & (F.col("d") >= F.col("least")) & (F.col("d") <= F.col("most"))).select("grp", "vec_id", "label", "v")
