"""An index of vectors that skips cells and stays exact.

Vectors get one more coordinate that makes all of them equally long, so a greater inner
product is a smaller distance. Each lies in the cell of its nearest centre (a sample of
``CELLS`` at most); the index is Parquet with a folder per cell, and a summary of each
cell's centre, size, least and greatest distance from the centre. By the triangle
inequality a query's distance to a cell's vectors lies within the radius of that to its
centre. A search scans the cells nearest to each query until they hold k vectors, and then
those that might still hold one nearer than the k-th found; the others are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import day
from ..sources.scratch import staged
from .retrieval import HITS, QUERY_BLOCK, best_of_tile, ranked

CELLS = 1024
#: More than rounding can shift a distance of vectors whose components are 1 at most.
SLACK = 1e-6
TILE = 1 << 21


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _longer(v: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(longest * longest - (v * v).sum(1), 0.0))])


def _placed(centres: np.ndarray, longest: float, names: list[str]):
    def run(batches):
        for batch in batches:
            v = _longer(_matrix(batch.column("embedding")), longest)
            cell, near = np.zeros(len(v), np.int32), np.zeros(len(v))
            step = max(1, TILE // len(centres))
            for lo in range(0, len(v), step):
                d = _distances(v[lo : lo + step], centres)
                cell[lo : lo + step], near[lo : lo + step] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], names=[*names, "cell", "d"])

    return run


def build(articles: DataFrame, path: str, cells: int = CELLS) -> None:
    """Writes the index of (article_id, published_date, embedding) to ``path``; null vectors are left out."""
    spark = articles.sparkSession
    rows = articles.filter("embedding is not null").select(F.col("article_id").cast("long"), day("published_date").alias("day"), "embedding")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = float(np.sqrt(rows.agg(F.max(square)).first()[0] or 0.0))
    sample = rows.select("embedding", F.xxhash64("article_id").alias("h"), "article_id").orderBy("h", "article_id").limit(cells).select("embedding").toArrow()["embedding"].combine_chunks()
    centres = np.unique(_longer(_matrix(sample), longest), axis=0) if len(sample) else np.zeros((1, 1))
    placed = rows.mapInArrow(_placed(centres, longest, rows.columns), "article_id long, day string, embedding array<float>, cell int, d double")
    # Cells are written by ranges of their numbers; a crowded one by several tasks.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(width, "cell", "article_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    each = spark.read.schema("article_id long, d double, cell int").parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
    places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    each.join(F.broadcast(places), "cell").withColumn("longest", F.lit(longest)).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


@dataclass
class _Cells:
    """The summary: as many rows as there are cells."""

    names: np.ndarray
    n: np.ndarray
    least: np.ndarray
    most: np.ndarray
    centres: np.ndarray
    longest: float


def _summary(spark: SparkSession, path: str) -> _Cells | None:
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    if not table.num_rows:
        return None
    get = lambda c: table[c].combine_chunks().to_numpy()
    return _Cells(get("cell"), get("n"), get("least"), get("most"), _matrix(table["centre"].combine_chunks()), float(get("longest")[0]))


def _scan(ids: np.ndarray, vectors: np.ndarray, asks: dict[int, np.ndarray], k: int):
    """The best of each cell's vectors for the queries that ask for the cell."""

    def run(batches):
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            article = batch.column("article_id").to_numpy()
            matrix = _matrix(batch.column("embedding"))
            for cell in np.unique(cells):
                here = np.flatnonzero(cells == cell)
                who = asks.get(int(cell), np.zeros(0, np.int64))
                step = max(1, TILE // len(here))
                for lo in range(0, len(who), step):
                    some = who[lo : lo + step]
                    score = np.round(vectors[some] @ matrix[here].T, 9)
                    q, j = best_of_tile(score, article[here], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][q]), pa.array(article[here][j]), pa.array(score[q, j])], names=["query_id", "article_id", "score"])

    return run


def _asked(spark: SparkSession, path: str, cells: _Cells, pairs: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """Hits of the (query, cell) ``pairs``, a matrix of booleans; cells that nobody asks for are not read."""
    wanted = np.flatnonzero(pairs.any(0))
    asks = {int(cells.names[c]): np.flatnonzero(pairs[:, c]) for c in wanted}
    rows = spark.read.schema("article_id long, embedding array<float>, cell int").parquet(f"{path}/rows").filter(F.col("cell").isin([int(c) for c in cells.names[wanted]]))
    return staged(ranked(rows.select("article_id", "embedding", "cell").mapInArrow(_scan(ids, vectors, asks, k), HITS), k).drop("rank"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, rank, article_id, score), ties by id, as a full scan gives them; and (query_id, cells, scanned, vectors, read) of each query.

    ``queries``: query_id, vector; a block of them travels with a scan.
    """
    cells = _summary(spark, path)
    listed = queries.select(F.col("query_id").cast("long"), "vector").filter("vector is not null")
    number = 1 + listed.count() // query_block
    part = F.pmod(F.xxhash64("query_id"), F.lit(number))
    hits, work = spark.createDataFrame([], HITS), spark.createDataFrame([], "query_id long, cells int, scanned int, vectors long, read long")
    for b in range(number) if cells else ():
        table = listed.filter(part == b).toArrow()
        if not table.num_rows:
            continue
        ids, vectors = table["query_id"].combine_chunks().to_numpy(), _matrix(table["vector"].combine_chunks())
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.where(norms > 0, norms, 1.0)
        # In units of the longest vector: a query is 1 long, its extra coordinate 0.
        scale = cells.longest or 1.0
        to = _distances(np.column_stack([vectors, np.zeros(len(ids))]), cells.centres / scale)
        nearest = np.maximum(np.maximum(to - cells.most / scale, cells.least / scale - to), 0.0)
        order = np.argsort(nearest, axis=1, kind="stable")
        held = np.cumsum(cells.n[order], axis=1)
        first = np.zeros(to.shape, bool)
        np.put_along_axis(first, order, np.column_stack([np.zeros(len(ids)), held[:, :-1]]) < k, axis=1)
        found = _asked(spark, path, cells, first, ids, vectors, k)
        kth = {r.query_id: r.least for r in found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k).collect()}
        least = np.array([kth.get(int(i), -np.inf) for i in ids])
        length = (vectors * vectors).sum(1)
        within = np.sqrt(np.maximum(length + 1.0 - 2.0 * (least - SLACK) / scale, 0.0)) + SLACK
        more = (nearest <= within[:, None]) & ~first
        if more.any():
            found = found.unionAll(_asked(spark, path, cells, more, ids, vectors, k))
        hits = hits.unionAll(found)
        seen = first | more
        told = [(int(i), len(cells.names), int(s.sum()), int(cells.n.sum()), int(cells.n[s].sum())) for i, s in zip(ids, seen, strict=True)]
        work = work.unionAll(spark.createDataFrame(told, work.schema))
    return ranked(hits, k), work
