"""Distances between vectors in array columns, as Column expressions and as a NumPy kernel.

Sums run in double.  ``l2`` is the squared Euclidean distance, ``inner_product`` the negated dot product, so
that smaller is always nearer; cosine distance is 1 where a norm is (nearly) zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Products of norms, and norms, below this count as zero (a fixed value of the search semantics).
TINY = 1e-12

#: Elements of an array that a kernel makes for pairs of vectors: some ten of them are alive at once, whatever the number of queries or cells.
PAIRS = 1 << 18


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _each(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(_each(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_sq(a: Column, b: Column) -> Column:
    return _sum(_each(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_sq(a, b))


def cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both < TINY, F.lit(1.0)).otherwise(F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / both)))


def inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def normalize(v: Column) -> Column:
    """Unit length; vectors of (nearly) no length stay as they are."""
    return F.when(norm(v) < TINY, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm(v)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2_sq, "cosine": cosine, "inner_product": inner_product}


def metric(name: str) -> Callable[[Column, Column], Column]:
    """Distance of a metric; unknown names are an error."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def vector(values) -> Column:
    """A literal vector."""
    return F.array(*(F.lit(float(x)) for x in values))


def direct(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of ``a`` to the same rows of ``b``, in double; equal vectors get equal distances wherever they stand."""
    if name == "l2":
        return ((a - b) ** 2).sum(1)
    product = (a * b).sum(1)
    if name == "inner_product":
        return 0.0 - product
    both = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.where(both < TINY, 1.0, 1.0 - np.clip(product / np.where(both < TINY, 1.0, both), -1.0, 1.0))


def pairwise(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of ``a`` to every row of ``b`` by one matrix product; ``slack`` bounds their error."""
    metric(name)
    a, b = np.asarray(a, float), np.asarray(b, float)
    product = a @ b.T
    if name == "inner_product":
        return 0.0 - product
    square_a, square_b = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    if name == "l2":
        return np.maximum(square_a + square_b - 2 * product, 0.0)
    both = np.sqrt(square_a) * np.sqrt(square_b)
    return np.where(both < TINY, 1.0, 1.0 - np.clip(product / np.where(both < TINY, 1.0, both), -1.0, 1.0))


def slack(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far ``pairwise`` and ``direct`` may differ, for each row of ``a``."""
    unit = 8 * (a.shape[1] + 8) * np.finfo(float).eps
    if name == "cosine":
        return np.full(len(a), unit)
    return unit * ((a * a).sum(1) + ((b * b).sum(1).max() if len(b) else 0.0))


def chosen(name: str, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``direct`` distances of the pairs (a[i], b[j])."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    block = max(PAIRS // max(a.shape[1], 1), 1)
    return np.concatenate([direct(name, a[i[k : k + block]], b[j[k : k + block]]) for k in range(0, max(len(i), 1), block)])


def nearest_row(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the nearest row of ``b`` for each row of ``a``; of equally near ones the lowest."""
    step = max(PAIRS // max(len(b), 1), 1)
    if len(a) > step:
        return np.concatenate([nearest_row(name, a[k : k + step], b) for k in range(0, len(a), step)])
    near = pairwise(name, a, b)
    found = near.argmin(1)
    i, j = np.nonzero(near <= (near[np.arange(len(a)), found] + 2 * slack(name, np.asarray(a, float), np.asarray(b, float)))[:, None])
    if len(i) > len(a):
        order = np.lexsort((j, chosen(name, a, b, i, j), i))
        found = j[order][np.flatnonzero(np.diff(i[order], prepend=-1))]
    return found
