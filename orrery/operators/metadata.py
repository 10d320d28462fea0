"""Metadata of vectors: a text for each vec_id, with upsert, lookup, delete, and text filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.flat import delete_status
from orrery.sources.store import load_version, save_version, versions


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """(vec_id, metadata): of each id the change with the highest version, else what it had.

    ``changes``: vec_id, metadata, version; null metadata is an error.  Equal versions: the greater text.
    """
    checked = changes.where(F.when(F.col("metadata").isNull(), F.raise_error(F.lit("metadata is null")).cast("boolean")).otherwise(F.lit(True)))
    last = checked.groupBy("vec_id").agg(F.max(F.struct("version", "metadata"))["metadata"].alias("new"))
    both = store.select("vec_id", "metadata").join(last, "vec_id", "full_outer")
    return both.select("vec_id", F.coalesce("new", "metadata").alias("metadata"))


def lookup(ids: DataFrame, store: DataFrame) -> DataFrame:
    """(vec_id, metadata) of each asked id; null where there is none."""
    return ids.select("vec_id").join(store, "vec_id", "left").select("vec_id", "metadata")


def remove_status(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(vec_id, removed) for each asked id: false where the store does not have it."""
    return delete_status(store, ids.select("vec_id")).withColumnRenamed("deleted", "removed")


def remove(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without ``ids``."""
    return store.join(ids.select("vec_id"), "vec_id", "left_anti")


def orphans(store: DataFrame, live: DataFrame) -> DataFrame:
    """Metadata whose vector is not there (any more)."""
    return store.join(live.select("vec_id"), "vec_id", "left_anti")


def with_metadata(vectors: DataFrame, store: DataFrame) -> DataFrame:
    return vectors.join(store, "vec_id", "left")


def contains(text: str) -> Column:
    """Filter: the metadata has ``text`` in it.  Vectors without metadata do not match."""
    return F.coalesce(F.col("metadata").contains(text), F.lit(False))


def field_is(path: str, value: str) -> Column:
    """Filter: a field of JSON metadata has a value."""
    return F.coalesce(F.get_json_object("metadata", path) == value, F.lit(False))


def save(store: DataFrame, path: str) -> int:
    """Write the store as a new version; its number.  An empty store is a version like any other."""
    return save_version(store.sparkSession, path, {"metadata": store.select("vec_id", "metadata")}, {"kind": "metadata"})


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The store as saved; where nothing was saved, an empty one."""
    if version is None and not versions(spark, path):
        return spark.createDataFrame([], "vec_id long, metadata string")
    return load_version(spark, path, "metadata", version)[0]["metadata"]
