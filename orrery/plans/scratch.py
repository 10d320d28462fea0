"""Intermediate tables in the folder that the driver and all executors share.

A table written here cuts the lineage and survives the loss of any executor, which a local
checkpoint does not.  The folder is the session's ``spark.checkpoint.dir``, or the one given to
``SparkContext.setCheckpointDir``; only where neither is set and all tasks run in the driver's own process (tests, one machine)
a folder of our own takes its place.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 1000

_own: list[str] = []
#: The tables of the blocks that each thread is in.
_open = threading.local()


def _blocks() -> list[list[DataFrame]]:
    if not hasattr(_open, "blocks"):
        _open.blocks = []
    return _open.blocks


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    given = spark._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="orrery-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder name that no earlier call has returned; nothing is created."""
    return f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches for Python of ``BATCH`` rows at most: rows hold whole texts, and executors hold a batch twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH:
        yield
        return
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it."""
    path = new_dir(df.sparkSession, name)
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _blocks():
        _blocks()[-1].append(out)
    return out


@contextlib.contextmanager
def passing(keep: list[DataFrame]) -> Iterator[None]:
    """Tables written inside are dropped at the end, but for those put into ``keep``.

    What leaves the block must not read a dropped table: write it, and keep it.
    """
    _blocks().append([])
    try:
        yield
    finally:
        mine = _blocks().pop()
        for df in mine:
            if not any(df is k for k in keep):
                drop(df)
            elif _blocks():
                _blocks()[-1].append(df)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later plan reads."""
    spark = df.sparkSession
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/orrery-" in top:
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """Hint a broadcast of ``df`` if it has at most ``rows`` rows; else leave the join to Spark.

    ``weight`` counts for a row that holds an array.  ``df`` should be cheap to count: a table from ``written``.
    """
    found = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first().n
    return F.broadcast(df) if found <= rows else df
