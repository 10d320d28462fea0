"""Approximate index: vectors in k-means cells, of which a search looks into the nearest few."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from orrery.functions.distance import metric, nearest_row
from orrery.operators import topk
from orrery.operators.flat import MAX_DIM, delete_status, validated
from orrery.sources.store import load_version, save_version

#: Defaults of the index (fixed values of the search semantics).
NLIST, NPROBE, ROUNDS, TOLERANCE = 128, 8, 25, 1e-6


def first_vectors(vectors: DataFrame, n: int) -> np.ndarray:
    """The first n vectors by vec_id: deterministic centroids."""
    rows = vectors.select("vec_id", "embedding").orderBy("vec_id").limit(n).collect()
    return np.array([r.embedding for r in rows], float)


def chosen_vectors(vectors: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """n vectors chosen by a hash of vec_id and ``seed``."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n).collect()
    return np.array([r.embedding for r in rows], float)


def _cells(centroids: np.ndarray, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cid = nearest_row(name, topk.as_matrix(part.column(part.schema.get_field_index("embedding"))), centroids)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cid.astype(np.int32))], names=[*part.schema.names, "cid"])

    return run


def assign(vectors: DataFrame, centroids: np.ndarray, name: str = "l2") -> DataFrame:
    """``vectors`` with cid, the nearest centroid's number; of equal ones the lowest."""
    schema = StructType([*vectors.schema.fields, StructField("cid", IntegerType())])
    return vectors.mapInArrow(_cells(centroids, name), schema)


def _sums(centroids: np.ndarray, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = topk.as_matrix(batch.column(0).slice(at, 2048))
                cid = nearest_row(name, x, centroids)
                order = np.argsort(cid, kind="stable")
                first = np.flatnonzero(np.diff(cid[order], prepend=-1))
                total[cid[order][first]] += np.add.reduceat(x[order], first)
                count += np.bincount(cid, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cid", "n", "total"])

    return run


def lloyd_step(vectors: DataFrame, centroids: np.ndarray, name: str = "l2") -> DataFrame:
    """(cid, n, centroid) of the cells that have vectors: means of one round; each task sends one row a cell."""
    parts = vectors.select("embedding").mapInArrow(_sums(centroids, name), "cid int, n long, total array<double>")
    # one pass: the number of vectors travels as element 0 of the sums
    every = parts.select("cid", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "total"))).groupBy("cid", "pos").agg(F.sum("col").alias("s"))
    sums = every.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("s"))
    n = F.element_at("s", 1)
    return sums.select("cid", n.cast("long").alias("n"), F.transform(F.slice("s", 2, F.size("s") - 1), lambda x: x / n).alias("centroid"))


def train(vectors: DataFrame, centroids: np.ndarray, name: str = "l2", rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[float]]:
    """Lloyd's rounds; returns centroids and the largest shift (squared) of each round.

    Cells are assigned by the metric and updated by the mean; an empty cell keeps its centroid.  Only the
    centroids, of a fixed number, come to the driver.
    """
    centroids, shifts = centroids.copy(), []
    for _ in range(rounds):
        new = centroids.copy()
        for r in lloyd_step(vectors, centroids, name).collect():
            new[r.cid] = r.centroid
        shifts.append(float(((new - centroids) ** 2).sum(1).max()))
        centroids = new
        if shifts[-1] < tolerance:
            break
    return centroids, shifts


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, name: str = "l2") -> DataFrame:
    """(query_id, rank, cid, distance): the nprobe nearest cells of each query; centroids: (cid, centroid)."""
    cells = centroids.select(F.col("cid").alias("vec_id"), F.col("centroid").alias("embedding"))
    found = topk.nearest_batch(cells, queries, nprobe, name)
    return found.select("query_id", "rank", F.col("vec_id").cast("int").alias("cid"), "distance")


@dataclass(frozen=True)
class IvfIndex:
    """Cells of vectors; operations return a new index.  Created untrained: only ``train`` works then."""

    spark: SparkSession
    dim: int
    metric: str = "l2"
    nlist: int = NLIST
    nprobe: int = NPROBE
    centroids: np.ndarray | None = field(default=None, compare=False)
    vectors: DataFrame | None = None
    tombstones: DataFrame | None = None
    blocks: DataFrame | None = None

    @classmethod
    def create(cls, spark: SparkSession, dim: int, name: str = "l2", nlist: int = 0, nprobe: int = 0) -> IvfIndex:
        """0 means the default; nprobe is at most nlist."""
        metric(name)
        if not 1 <= dim <= MAX_DIM:
            raise ValueError(f"dim must be 1 to {MAX_DIM}")
        nlist = nlist or NLIST
        return cls(spark, dim, name, nlist, min(nprobe or NPROBE, nlist))

    @property
    def is_trained(self) -> bool:
        return self.centroids is not None

    def _trained(self) -> np.ndarray:
        if self.centroids is None:
            raise RuntimeError("the index is not trained")
        return self.centroids

    def train(self, sample: DataFrame, start: np.ndarray | None = None, seed: int = 0, rounds: int = ROUNDS) -> IvfIndex:
        """Fit the cells to ``sample``; its vectors are not inserted."""
        if self.is_trained:
            raise RuntimeError("the index is trained already")
        sample = validated(sample, self.dim).select("vec_id", "embedding").persist()
        start = chosen_vectors(sample, self.nlist, seed) if start is None else start
        if len(start) < self.nlist:
            raise ValueError(f"training needs {self.nlist} vectors at least")
        centroids, _ = train(sample, start, self.metric, rounds)
        sample.unpersist()
        return replace(self, centroids=centroids)

    def insert(self, more: DataFrame) -> IvfIndex:
        """Put one or many vectors into their cells, in one job."""
        more = assign(validated(more, self.dim), self._trained(), self.metric)
        vectors, gone = self.vectors, self.tombstones
        if gone is not None:  # a deleted id may come back, with the new vector alone
            back = more.select("vec_id").distinct()
            vectors, gone = vectors.join(gone.join(back, "vec_id", "left_semi"), "vec_id", "left_anti"), gone.join(back, "vec_id", "left_anti")
        return replace(self, vectors=more if vectors is None else vectors.unionByName(more, allowMissingColumns=True), tombstones=gone, blocks=None)

    def prepared(self) -> IvfIndex:
        """The same with its live vectors assigned once, packed by cell and kept for many batch searches, until ``release``."""
        rows = self.live().persist()
        return replace(self, vectors=rows, tombstones=None, blocks=packed(rows).persist())

    def release(self) -> None:
        """Give up what ``prepared`` keeps."""
        for kept in (self.vectors, self.blocks):
            if kept is not None:
                kept.unpersist()

    def live(self) -> DataFrame:
        if self.vectors is None:
            return self.spark.createDataFrame([], "vec_id long, embedding array<double>, cid int")
        return self.vectors if self.tombstones is None else self.vectors.join(self.tombstones, "vec_id", "left_anti")

    def delete(self, ids: DataFrame) -> tuple[IvfIndex, DataFrame]:
        status = delete_status(self.live(), ids.select("vec_id"))
        gone = ids.select("vec_id").distinct()
        return replace(self, tombstones=gone if self.tombstones is None else self.tombstones.union(gone).distinct(), blocks=None), status

    def count(self) -> int:
        return self.live().count()

    def cells_of(self, query: Sequence[float], nprobe: int | None = None) -> list[int]:
        """Numbers of the cells to look into, nearest first."""
        n = self.nprobe if nprobe is None else nprobe
        if n < 1:
            raise ValueError("nprobe must be 1 at least")
        cells = topk.Best(np.array([query], float), min(n, len(self._trained())), self.metric)
        cells.add(np.arange(len(self._trained())), self._trained())
        return cells.i[0].tolist()

    def search(self, query: Sequence[float], k: int, where: Column | str | None = None, nprobe: int | None = None) -> DataFrame:
        """(rank, vec_id, distance); the cells are literals, so only their folders are read."""
        cells = self.cells_of(query, nprobe)
        rows = self.live().where(F.col("cid").isin(cells))
        rows = rows if where is None else rows.where(where)
        return topk.ranked(topk.nearest(rows, query, k, self.metric).select(F.lit(0).alias("query_id"), "vec_id", "distance"), k).drop("query_id")

    def search_batch(self, queries: DataFrame, k: int, where: Column | str | None = None, nprobe: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, distance); each query meets only the vectors of its cells."""
        n = self.nprobe if nprobe is None else nprobe
        if n < 1:
            raise ValueError("nprobe must be 1 at least")
        rows = self.live() if where is not None or self.blocks is None else self.blocks
        rows = rows if where is None else rows.where(where)
        return probed(rows, queries, self._trained(), n, k, self.metric)

    def compact(self) -> tuple[IvfIndex, int]:
        self._trained()
        reclaimed = 0 if self.tombstones is None or self.vectors is None else self.vectors.join(self.tombstones, "vec_id", "left_semi").count()
        return replace(self, vectors=self.live(), tombstones=None, blocks=None), reclaimed

    def centroid_table(self) -> DataFrame:
        return self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self._trained())], "cid int, centroid array<double>")

    def save(self, path: str) -> int:
        tables = {"vectors": self.live() if self.vectors is None else self.vectors, "centroids": self.centroid_table()} | ({} if self.tombstones is None else {"tombstones": self.tombstones})
        about = {"kind": "ivf", "dim": self.dim, "metric": self.metric, "nlist": self.nlist, "nprobe": self.nprobe}
        return save_version(self.spark, path, tables, about, {"vectors": ["cid"]})

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> IvfIndex:
        tables, about = load_version(spark, path, "ivf", version)
        rows = sorted(tables["centroids"].collect(), key=lambda r: r.cid)
        return cls(spark, about["dim"], about["metric"], about["nlist"], about["nprobe"], np.array([r.centroid for r in rows], float), tables["vectors"], tables.get("tombstones"))


def packed(vectors: DataFrame, rows: int = 2048) -> DataFrame:
    """(cid, vec_ids, matrix): the vectors of each cell in blocks of up to ``rows``, as the bytes of long ids and of floats or doubles.

    Such blocks reach the kernels as they are, while arrays are copied element by element.
    """
    wide = vectors.schema["embedding"].dataType.elementType.typeName() == "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column(2).to_numpy(zero_copy_only=False)
            out = []
            for part in np.split(np.arange(len(cid)), np.flatnonzero(np.diff(cid)) + 1):
                for at in range(0, len(part), rows):
                    some = batch.slice(int(part[at]), min(rows, len(part) - at))
                    matrix = topk.as_matrix(some.column(1)).astype("<f8" if wide else "<f4")
                    out.append((int(cid[part[at]]), some.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), matrix.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["cid", "vec_ids", "matrix"])

    laid = vectors.select("vec_id", "embedding", "cid").hint("rebalance", "cid").sortWithinPartitions("cid")
    return laid.mapInArrow(run, "cid int, vec_ids binary, matrix binary")


def _probed(ids: np.ndarray, matrix: np.ndarray, cells: np.ndarray, k: int, name: str, blocks: bool):
    """Kernel of one block of queries: each vector is scored for the queries that look into its cell."""
    order = np.argsort(cells.ravel(), kind="stable")
    names, first = np.unique(cells.ravel()[order], return_index=True)
    asked = dict(zip(names.tolist(), np.split(order // cells.shape[1], first[1:]), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = topk.Best(matrix, k, name)
        for batch in batches:
            if blocks:
                kind = "<f8" if batch.num_rows and len(batch.column(2)[0].as_py()) == len(batch.column(1)[0].as_py()) * matrix.shape[1] else "<f4"
                for c, i, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    if c in asked:
                        best.add(np.frombuffer(i.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), kind).reshape(-1, matrix.shape[1]), asked[c])
                continue
            cid, vec = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            x = topk.as_matrix(batch.column(1))
            for c in np.unique(cid).tolist():
                at = np.flatnonzero(cid == c)
                for low in range(0, len(at) if c in asked else 0, 2048):
                    best.add(vec[at[low : low + 2048]], x[at[low : low + 2048]], asked[c])
        yield best.batch(ids)

    return run


def probed(vectors: DataFrame, queries: DataFrame, centroids: np.ndarray, nprobe: int, k: int, name: str = "l2", block: int = topk.QUERY_BLOCK) -> DataFrame:
    """Search of the nprobe nearest cells for many queries; ``vectors`` has vec_id, embedding, cid, or is the result of ``packed``."""
    out, held, blocks = None, [], "matrix" in vectors.columns
    columns = ["cid", "vec_ids", "matrix"] if blocks else ["vec_id", "embedding", "cid"]

    def add() -> None:
        nonlocal out, held
        matrix = np.array([r[1] for r in held], float)
        best = topk.Best(matrix, min(nprobe, len(centroids)), name)
        best.add(np.arange(len(centroids)), centroids)
        cells = best.i
        # cells nobody asks for are not read at all
        rows = vectors.where(F.col("cid").isin(np.unique(cells).tolist())).select(*columns)
        found = rows.mapInArrow(_probed(np.array([r[0] for r in held], np.int64), matrix, cells, k, name, blocks), "query_id long, vec_id long, distance double")
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
    return topk.ranked(out, k)
