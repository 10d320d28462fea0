"""Exact index: validation, inserts, logical deletes, filtered search, compaction, save and load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.distance import metric
from orrery.operators import topk
from orrery.sources.store import load_version, save_version

#: Largest number of dimensions (a fixed value of the index format).
MAX_DIM = 2000


def malformed(dim: int) -> Column:
    """Whether a row cannot be indexed: null id or vector, wrong length, an element that is null, NaN or infinite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != dim) | F.coalesce(bad, F.lit(True))


def validated(vectors: DataFrame, dim: int, strict: bool = True) -> DataFrame:
    """Rows that can be indexed.  ``strict``: a malformed row is an error when it is read; else it is left out."""
    if not 1 <= dim <= MAX_DIM:
        raise ValueError(f"dim must be 1 to {MAX_DIM}")
    if not strict:
        return vectors.where(~malformed(dim))
    return vectors.where(F.when(malformed(dim), F.raise_error(F.lit("malformed vector")).cast("boolean")).otherwise(F.lit(True)))


def delete_status(live: DataFrame, asked: DataFrame) -> DataFrame:
    """(vec_id, deleted) for each asked id: false where no live vector has it, or it is asked again."""
    known = asked.join(live.select("vec_id").distinct().withColumn("known", F.lit(True)), "vec_id", "left")
    return known.select("vec_id", F.coalesce("known", F.lit(False)).alias("deleted"))


@dataclass(frozen=True)
class FlatIndex:
    """Vectors (vec_id, embedding, and any other columns) with tombstones (vec_id); operations return a new index."""

    vectors: DataFrame
    dim: int
    metric: str = "l2"
    tombstones: DataFrame | None = None

    @classmethod
    def create(cls, vectors: DataFrame, dim: int, name: str = "l2", strict: bool = True) -> FlatIndex:
        metric(name)
        return cls(validated(vectors, dim, strict), dim, name)

    def live(self) -> DataFrame:
        return self.vectors if self.tombstones is None else self.vectors.join(self.tombstones, "vec_id", "left_anti")

    def insert(self, more: DataFrame) -> FlatIndex:
        """One or many vectors; an empty table changes nothing.

        Ids are the caller's and should not be those of live vectors; that of a deleted one may come back, with the new vector alone.
        """
        more = validated(more, self.dim)
        if self.tombstones is None:
            return replace(self, vectors=self.vectors.unionByName(more, allowMissingColumns=True))
        back = more.select("vec_id").distinct()
        kept = self.vectors.join(self.tombstones.join(back, "vec_id", "left_semi"), "vec_id", "left_anti")
        return replace(self, vectors=kept.unionByName(more, allowMissingColumns=True), tombstones=self.tombstones.join(back, "vec_id", "left_anti"))

    def delete(self, ids: DataFrame) -> tuple[FlatIndex, DataFrame]:
        """Hide vectors by id; also returns (vec_id, deleted)."""
        status = delete_status(self.live(), ids.select("vec_id"))
        gone = ids.select("vec_id").distinct()
        gone = gone if self.tombstones is None else self.tombstones.union(gone).distinct()
        return replace(self, tombstones=gone), status

    def get(self, ids: DataFrame) -> DataFrame:
        """The rows of ids (vec_id), deleted ones too, until the index is compacted."""
        return self.vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")

    def is_deleted(self, ids: DataFrame) -> DataFrame:
        """(vec_id, is_deleted) of each id; one that the index does not have counts as deleted."""
        return delete_status(self.live(), ids).select("vec_id", (~F.col("deleted")).alias("is_deleted"))

    def count(self, deleted: bool = False) -> int:
        """Live vectors; with ``deleted`` also those that are deleted and not yet compacted away."""
        return (self.vectors if deleted else self.live()).count()

    def prepared(self) -> FlatIndex:
        """The same with its live vectors kept in memory or on executors' disks for many searches, until ``release``."""
        return replace(self, vectors=self.live().persist(), tombstones=None)

    def release(self) -> None:
        """Give up what ``prepared`` keeps."""
        self.vectors.unpersist()

    def search(self, query: Sequence[float], k: int, where: Column | str | None = None) -> DataFrame:
        """(rank, vec_id, distance) of the k nearest live vectors that fulfil ``where``."""
        if len(query) != self.dim:
            raise ValueError(f"the query has {len(query)} dimensions, the index {self.dim}")
        rows = self.live() if where is None else self.live().where(where)
        return topk.ranked(topk.nearest(rows, query, k, self.metric).select(F.lit(0).alias("query_id"), "vec_id", "distance"), k).drop("query_id")

    def search_batch(self, queries: DataFrame, k: int, where: Column | str | None = None) -> DataFrame:
        """(query_id, rank, vec_id, distance) for queries (query_id, embedding)."""
        rows = self.live() if where is None else self.live().where(where)
        return topk.nearest_batch(rows, validated(queries.withColumnRenamed("query_id", "vec_id"), self.dim).withColumnRenamed("vec_id", "query_id"), k, self.metric)

    def compact(self) -> tuple[FlatIndex, int]:
        """Without the deleted rows, and how many those were.  Ids, and so metadata, stay valid."""
        reclaimed = 0 if self.tombstones is None else self.vectors.join(self.tombstones, "vec_id", "left_semi").count()
        return replace(self, vectors=self.live(), tombstones=None), reclaimed

    def save(self, path: str) -> int:
        """Write a new version below ``path``; its number."""
        tables = {"vectors": self.vectors} | ({} if self.tombstones is None else {"tombstones": self.tombstones})
        return save_version(self.vectors.sparkSession, path, tables, {"kind": "flat", "dim": self.dim, "metric": self.metric})

    @classmethod
    def load(cls, spark, path: str, version: int | None = None) -> FlatIndex:
        tables, about = load_version(spark, path, "flat", version)
        return cls(tables["vectors"], about["dim"], about["metric"], tables.get("tombstones"))
