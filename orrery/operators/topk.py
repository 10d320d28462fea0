"""Exact top-k: one query, many queries by expression, and many queries by an Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.distance import PAIRS, chosen, metric, pairwise, slack, vector

#: Queries that one pass over the vectors answers; more are answered in several passes.
QUERY_BLOCK = 4096


def as_matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, name: str = "l2") -> DataFrame:
    """(vec_id, distance) of the k nearest; ties go to the smaller vec_id.  k = 0 gives none."""
    distance = metric(name)(F.col("embedding"), vector(query))
    return vectors.select("vec_id", distance.alias("distance")).orderBy(F.asc_nulls_last("distance"), "vec_id").limit(k)


def ranked(distances: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance) to the k nearest of each query, with rank."""
    by = W.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    return distances.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def threshold(found: DataFrame, distance: Column | str = "distance") -> DataFrame:
    """The worst distance kept, infinity where nothing is."""
    return found.agg(F.coalesce(F.max(distance), F.lit(float("inf"))).alias("threshold"))


class Best:
    """The k nearest so far of each of some queries; ties go to the smaller vec_id.

    A matrix product finds what may be among them; those few distances are then computed directly.  Arrays of
    pairs have ``PAIRS`` elements at most.
    """

    def __init__(self, queries: np.ndarray, k: int, name: str) -> None:
        self.queries, self.k, self.name = np.asarray(queries, float), k, name
        self.d = np.full((len(queries), k), np.inf)
        self.i = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray, who: np.ndarray | None = None) -> None:
        """Vectors ``x`` with their ids, for the queries numbered ``who`` (all)."""
        who = np.arange(len(self.queries)) if who is None else who
        for low in range(0, len(x), 2048):
            part = np.asarray(x[low : low + 2048], float)
            step = max(PAIRS // max(part.shape[0], part.shape[1], self.k), 1)
            for at in range(0, len(who), step):
                self._add(ids[low : low + 2048], part, who[at : at + step])

    def _add(self, ids: np.ndarray, x: np.ndarray, who: np.ndarray) -> None:
        mine, limit = self.queries[who], self.d[who, -1]
        near = pairwise(self.name, mine, x)
        if near.shape[1] > self.k and np.isinf(limit).any():
            limit = np.minimum(limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        a, b = np.nonzero(near <= (limit + 2 * slack(self.name, mine, x))[:, None])
        if not len(a):
            return
        q = who[a]
        rows, size = np.unique(q, return_counts=True)
        every = np.concatenate([np.repeat(rows, self.k), q])
        d = np.concatenate([self.d[rows].ravel(), chosen(self.name, mine, x, a, b)])
        i = np.concatenate([self.i[rows].ravel(), ids[b]])
        order = np.lexsort((i, d, every))
        begin = np.concatenate([[0], np.cumsum(size + self.k)[:-1]])
        keep = order[(begin[:, None] + np.arange(self.k)).ravel()]
        self.d[rows], self.i[rows] = d[keep].reshape(-1, self.k), i[keep].reshape(-1, self.k)

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        """query_id, vec_id, distance of what there is."""
        full = self.d < np.inf
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, full.sum(1))), pa.array(self.i[full]), pa.array(self.d[full])], names=["query_id", "vec_id", "distance"])


def _kernel(ids: list, matrix: np.ndarray, k: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(matrix, k, name)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                best.add(part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False), as_matrix(part.column(1)))
        yield best.batch(np.array(ids, np.int64))

    return run


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, name: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest of each query (query_id, embedding): query_id, rank, vec_id, distance.

    Each task scores its vectors against a block of queries with a matrix product and keeps k for each query,
    so only tasks x queries x k rows are shuffled.  Queries are sent out ``block`` at a time.
    """
    metric(name)
    out, held = None, []

    def add() -> None:
        nonlocal out, held
        matrix = np.array([r[1] for r in held], float)
        found = vectors.select("vec_id", "embedding").mapInArrow(_kernel([r[0] for r in held], matrix, k, name), "query_id long, vec_id long, distance double")
        out, held = found if out is None else out.union(found), []

    if k > 0:
        for row in queries.select("query_id", "embedding").toLocalIterator():
            held.append(row)
            if len(held) == block:
                add()
        if held:
            add()
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
    return ranked(out, k)


def nearest_pairs(vectors: DataFrame, queries: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """The same by expressions alone: readable, for small query sets of checked size (at most ``QUERY_BLOCK``)."""
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return nearest_batch(vectors, queries, k, name)
    asked = F.broadcast(queries.select("query_id", F.col("embedding").alias("asked")))
    return ranked(vectors.join(asked).select("query_id", "vec_id", metric(name)(F.col("embedding"), F.col("asked")).alias("distance")), k)
