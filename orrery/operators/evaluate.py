"""Recall, the trade-off curve of probed cells, latency percentiles, and synthetic vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.ivf import probed
from orrery.operators.topk import nearest_batch


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (hits, expected, recall): the share of exact (query_id, vec_id) that was found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.select("query_id", "vec_id").join(hit, ["query_id", "vec_id"], "left")
    hits, n = F.coalesce(F.sum("hit"), F.lit(0)), F.count(F.lit(1))
    return both.agg(hits.alias("hits"), n.alias("expected"), F.round(hits / n, 6).alias("recall"))


def recall_by_distance(found: DataFrame, exact: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """The same, where a distance within ``tolerance`` of one of the query's exact distances counts."""
    exact = exact.groupBy("query_id").agg(F.collect_list("distance").alias("known"))
    near = F.exists("known", lambda x: F.abs(x - F.col("distance")) <= tolerance)
    hits = found.join(exact, "query_id").agg(F.coalesce(F.sum(F.when(near, 1).otherwise(0)), F.lit(0)).alias("hits"))
    n = exact.agg(F.coalesce(F.sum(F.size("known")), F.lit(0)).cast("long").alias("expected"))
    return hits.join(n).select("hits", "expected", F.round(F.col("hits") / F.col("expected"), 6).alias("recall"))


def curve(vectors: DataFrame, queries: DataFrame, centroids: np.ndarray, nprobes: Sequence[int], k: int, name: str = "l2") -> DataFrame:
    """(nprobe, hits, expected, recall, cells_share) for each number of probed cells."""
    exact = nearest_batch(vectors, queries, k, name)
    out = None
    for n in nprobes:
        row = recall(probed(vectors, queries, centroids, n, k, name), exact)
        row = row.select(F.lit(int(n)).alias("nprobe"), "*", F.round(F.lit(n / len(centroids)), 6).alias("cells_share"))
        out = row if out is None else out.union(row)
    return out


def percentiles(times: DataFrame, column: str, shares: Sequence[float], near: float = 1e-3) -> DataFrame:
    """(share, value): the element at place floor(n * share) of the sorted values, counted from 0; nulls do not count.

    Approximate quantiles (within 1e-4) bracket each place; the values below a bracket are counted, and only those inside it are sorted.
    """
    rows = times.select(F.col(column).alias("value")).where("value is not null")
    ends = sorted({min(max(p + d, 0.0), 1.0) for p in shares for d in (-near, near)})
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", ends, 10_000).alias("at")).first()
    if not about.n:
        return rows.select(F.lit(0.0).alias("share"), "value")
    at, out = dict(zip(ends, about["at"], strict=True)), None
    brackets = [(float(p), min(about.n - 1, int(np.floor(about.n * p))), at[min(max(p - near, 0.0), 1.0)], at[min(max(p + near, 0.0), 1.0)]) for p in shares]
    below = rows.agg(*(F.count(F.when(F.col("value") < F.lit(low), 1)).alias(f"b{k}") for k, (_, _, low, _) in enumerate(brackets))).first()
    for k, (share, place, low, high) in enumerate(brackets):
        inside = rows.where((F.col("value") >= F.lit(low)) & (F.col("value") <= F.lit(high))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        reach = F.lit(below[f"b{k}"]) + F.sum("n").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
        one = inside.withColumn("reach", reach).where(F.col("reach") > place).agg(F.min("value").alias("value")).select(F.lit(share).alias("share"), "value")
        out = one if out is None else out.union(one)
    return out


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """Uniform in [0, 1), made on the executors: element i of vector v depends on the seed, v and i alone."""
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)).cast("float"))
    return spark.range(n).select(F.col("id").alias("vec_id"), value.alias("embedding"))


def clustered_vectors(spark: SparkSession, n: int, dim: int, clusters: int, seed: int = 42, spread: float = 0.1) -> DataFrame:
    """Centres uniform in [-1, 1), normal noise around them; vector v belongs to cluster v modulo ``clusters``."""

    def unit(*parts):
        return (F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) + F.lit(0.5)) / float(1 << 30)

    centre = F.col("id") % clusters
    noise = lambda i: F.sqrt(-2 * F.log(unit("id", i, F.lit(seed)))) * F.cos(unit("id", i, F.lit(seed + 1)) * (2 * np.pi))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (unit(centre, i, F.lit(seed + 2)) * 2 - 1 + noise(i) * spread).cast("float"))
    return spark.range(n).select(F.col("id").alias("vec_id"), value.alias("embedding"))
