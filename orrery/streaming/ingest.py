"""Micro-batch ingest of vectors into the cells of a trained index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.flat import validated
from orrery.operators.ivf import assign


def ingest(stream: DataFrame, centroids: np.ndarray, dim: int, path: str, checkpoint: str, name: str = "l2", **trigger) -> StreamingQuery:
    """Validate, assign and append each micro-batch of (vec_id, embedding) below ``path``.

    A batch replaces its own folder, so one that runs again after a failure is not counted twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = assign(validated(batch, dim, strict=False), centroids, name)
        rows.write.mode("overwrite").partitionBy("cid").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark, path: str) -> DataFrame:
    """Everything the stream has committed: vec_id, embedding, cid (and batch)."""
    return spark.read.option("basePath", path).parquet(path).withColumn("cid", F.col("cid").cast("int"))
