"""Make this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each context, unless their path has it already."""
    context = spark.sparkContext
    there = {Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]}
    if ROOT in there or getattr(context, "_orrery_shipped", False):
        return
    top = tempfile.mkdtemp(prefix="orrery-")
    atexit.register(shutil.rmtree, top, ignore_errors=True)  # the driver serves the file while it runs
    shutil.copytree(ROOT / "orrery", f"{top}/src/orrery", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{top}/orrery", "zip", f"{top}/src"))
    context._orrery_shipped = True


def shipped(query: Callable) -> Callable:
    """The same function of (spark, ...), after ``ship``."""

    @functools.wraps(query)
    def run(spark: SparkSession, *more):
        ship(spark)
        return query(spark, *more)

    return run
