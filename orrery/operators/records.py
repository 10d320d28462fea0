"""Records of bytes by id, and where vectors and records would stand on pages of the classic layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.sources.store import load_version, save_version, versions

#: Bytes of a page for vectors, of a float, and the most vectors on a page (fixed values of the page layout).
PAGE_DATA, FLOAT, PAGE_MOST = 8044, 4, 1024


def page_capacity(dim: Column) -> Column:
    """Vectors of ``dim`` dimensions on a page; 0 where none fits."""
    fits = F.floor(F.lit(PAGE_DATA) / (F.lit(FLOAT) * dim))
    return F.when(dim > 0, F.least(F.lit(PAGE_MOST), fits)).otherwise(F.lit(0)).cast("long")


def page_addresses(vectors: DataFrame, dim: int, block: int = 100_000) -> DataFrame:
    """(vec_id, page, slot) in vec_id order.

    Places come from counts of vec_id ranges and a window inside each, so no task sees all rows.
    """
    part = F.floor(F.col("vec_id") / block).cast("long")
    rows = vectors.select("vec_id").withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy("part").orderBy("vec_id")) - 1
    placed = rows.withColumn("place", place).join(ahead, "part").withColumn("place", F.col("place") + F.col("ahead"))
    size = page_capacity(F.lit(dim))
    return placed.select("vec_id", F.floor(F.col("place") / size).cast("long").alias("page"), (F.col("place") % size).cast("long").alias("slot"))


def compacted_slots(vectors: DataFrame, deleted: DataFrame) -> DataFrame:
    """(page, vec_id, slot): slots after each page's live vectors have moved up, in their order."""
    live = vectors.join(deleted.select("vec_id"), "vec_id", "left_anti")
    return live.select("page", "vec_id", (F.row_number().over(W.partitionBy("page").orderBy("slot")) - 1).cast("long").alias("slot"))


def _full(rows: DataFrame) -> DataFrame:
    """``rows``, of which an empty payload is an error."""
    full = F.when(F.coalesce(F.octet_length("payload"), F.lit(0)) == 0, F.raise_error(F.lit("empty record")).cast("boolean")).otherwise(F.lit(True))
    return rows.where(full)


def insert(store: DataFrame, more: DataFrame) -> DataFrame:
    """Add records (id, payload); empty payloads are an error."""
    return store.unionByName(_full(more))


def get(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found, payload) of each asked id: false and null where there is none (any more)."""
    known = store.select("id", "payload", F.lit(True).alias("found"))
    return ids.select("id").join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "payload")


def update(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Records with new payloads where ``changes`` has their id; unknown ids change nothing, empty payloads are an error."""
    new = _full(changes.select("id", "payload")).withColumnRenamed("payload", "new")
    return store.join(new, "id", "left").select("id", F.coalesce("new", "payload").alias("payload"))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without ``ids``."""
    return store.join(ids.select("id"), "id", "left_anti")


def delete_status(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, deleted) of each asked id: false where the store does not have it, or no longer."""
    return get(store, ids).select("id", F.col("found").alias("deleted"))


def save(store: DataFrame, path: str) -> int:
    """Write the store as a new version; its number."""
    return save_version(store.sparkSession, path, {"records": store.select("id", "payload")}, {"kind": "records"})


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The records of a version, the newest by default."""
    return load_version(spark, path, "records", version)[0]["records"]


def compact(store: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Rewrite the store at ``path`` as it is now, without what deletes and updates left behind: (store, records dropped from the last version)."""
    spark = store.sparkSession
    before = load(spark, path).count() if versions(spark, path) else 0
    save(store, path)
    now = load(spark, path)
    return now, before - now.count()
