"""Redo log of key changes: append, replay, checkpoint, with a checksum on every row.

Rows: lsn, op ('put' or 'delete'), vec_id, payload, crc (standard CRC-32 of all four).  The row with the
highest lsn of a key wins; of equal lsn the greater payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.store import load_version, save_version, versions


def checksum(lsn: Column | str = "lsn", op: Column | str = "op", vec_id: Column | str = "vec_id", payload: Column | str = "payload") -> Column:
    """CRC-32 of the row: lsn, op and vec_id as text, each ended by a zero byte, then the payload's bytes (none for null)."""
    head = F.concat_ws("\0", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in (lsn, op, vec_id)), F.lit(""))
    payload = F.col(payload) if isinstance(payload, str) else payload
    return F.crc32(F.concat(head.cast("binary"), F.coalesce(payload.cast("binary"), F.lit(b""))))


def entries(changes: DataFrame) -> DataFrame:
    """(lsn, op, vec_id, payload) with crc, ready to be appended."""
    rows = changes.select("lsn", "op", "vec_id", F.col("payload").cast("binary").alias("payload"))
    return rows.withColumn("crc", checksum())


def append(changes: DataFrame, path: str) -> None:
    entries(changes).write.mode("append").parquet(path)


def intact(log: DataFrame) -> DataFrame:
    return log.where(checksum() == F.col("crc"))


def corrupt(log: DataFrame) -> DataFrame:
    return log.where(F.coalesce(checksum() != F.col("crc"), F.lit(True)))


def replay(base: DataFrame, log: DataFrame) -> DataFrame:
    """(vec_id, payload) after the intact rows of ``log``; corrupt rows are passed over."""
    last = intact(log).groupBy("vec_id").agg(F.max(F.struct("lsn", "payload", "op")).alias("x"))
    both = base.select("vec_id", "payload").join(last, "vec_id", "full_outer")
    kept = both.where("x is null or x.op = 'put'")
    return kept.select("vec_id", F.when(F.col("x").isNull(), F.col("payload")).otherwise(F.col("x.payload")).alias("payload"))


def checkpoint(base: DataFrame, log: DataFrame) -> DataFrame:
    """The same, but a corrupt row is an error, raised when the result is computed; then the log can be emptied."""
    bad = F.coalesce(checksum() != F.col("crc"), F.lit(True))
    return replay(base, log.where(F.when(bad, F.raise_error(F.lit("corrupt row in the log")).cast("boolean")).otherwise(F.lit(True))))


def recover(base: DataFrame, path: str) -> DataFrame:
    """``base`` after the log at ``path``, as at opening; without a log it stays as it is."""
    spark = base.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return base.select("vec_id", "payload")
    if not any(s.getPath().getName().endswith(".parquet") for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)):
        return base.select("vec_id", "payload")
    return replay(base, spark.read.parquet(path))


def checkpoint_to(base: DataFrame, path: str, table: str) -> int:
    """Write ``base`` after the log as a new version of ``table``, then delete the log's files that were read; a corrupt row leaves both alone.

    Rows that are appended meanwhile stand in other files and stay.
    """
    spark = base.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(at)):
        return save_version(spark, table, {"base": base.select("vec_id", "payload")}, {"kind": "base"})
    log = spark.read.parquet(path)
    files = log.inputFiles()
    number = save_version(spark, table, {"base": checkpoint(base, log)}, {"kind": "base"})
    for name in files:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)), False)
    return number


def opened(spark, path: str, table: str) -> DataFrame:
    """The newest checkpoint of ``table`` after the log at ``path``."""
    empty = spark.createDataFrame([], "vec_id long, payload binary")
    return recover(load_version(spark, table, "base")[0]["base"] if versions(spark, table) else empty, path)
