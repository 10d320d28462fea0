"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.scratch import drop, written

ROUNDS = 40
#: Edges that a task puts together before the first round.
EDGES = 500_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is joined to) for each node of the edges other than the smallest ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges to a forest with the same components."""
    parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
    if parts:
        a, b = local_roots(*np.concatenate(parts, 1))
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): every node of an edge, with the smallest node it is connected to.

    Tasks first replace ``EDGES`` edges each by a forest, so that a dense group has few edges in the rounds.
    Each step is written to the shared folder; a step's input is dropped once it is replaced.
    """
    raw = written(edges.where("a <> b").select("a", "b"), "edges")
    forest = raw.repartition(max(1, -(-raw.count() // EDGES))).mapInArrow(_contract, "a long, b long")
    edges = written(forest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    drop(raw)
    state = _digest(edges)
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        near = large.join(low, large["a"] == low["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(near.union(low).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        drop(large)
        drop(edges)
        edges, before = new, state
        state = _digest(edges)
        if state == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
