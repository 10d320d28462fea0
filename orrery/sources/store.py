"""Versioned tables with a manifest, on any file system Spark can reach.

A version is a folder of Parquet tables.  Its manifest is written last, under another name, and then
renamed: until then the version does not exist for readers, and what an interrupted save leaves is never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

FORMAT = 1


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    found = (re.fullmatch(r"v(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(at))
    return sorted(int(m[1]) for m in found if m)


def save_version(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], about: Mapping, partition_by: Mapping[str, Sequence[str]] | None = None) -> int:
    """Write ``tables`` as the next version; returns its number."""
    fs, at = _fs(spark, path)
    fs.mkdirs(at)
    taken = [int(m[1]) for s in fs.listStatus(at) if (m := re.match(r"v(\d+)", s.getPath().getName()))]
    number = max(taken, default=0) + 1
    for name, df in tables.items():
        keys = (partition_by or {}).get(name)
        # one task for each key's rows, so that a key has few files; large keys are split by rebalancing
        (df.hint("rebalance", *keys).write.partitionBy(*keys) if keys else df.write).parquet(f"{path}/v{number}/{name}")
    text = json.dumps({"format": FORMAT, "tables": sorted(tables), **about})
    draft = _path(spark, f"{path}/v{number}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, _path(spark, f"{path}/v{number}.json")):
        raise OSError(f"version {number} of {path} could not be committed")
    return number


def load_version(spark: SparkSession, path: str, kind: str, version: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Tables and description of a version, the newest by default."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path} has no such version; complete versions: {known}")
    number = known[-1] if version is None else version
    about = json.loads("".join(r.value for r in spark.read.text(f"{path}/v{number}.json", wholetext=True).collect()))
    if about.get("format") != FORMAT or about.get("kind") != kind:
        raise ValueError(f"{path} is not a {kind} index of format {FORMAT}")
    return {t: spark.read.parquet(f"{path}/v{number}/{t}") for t in about["tables"]}, about
