"""Ships this package to executors that could not import it."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once, unless workers find it by their path."""
    found = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _shipped or _ROOT in (os.path.realpath(p) for p in found if p) or os.path.realpath(os.getcwd()) == _ROOT:
        return
    # The driver serves the archive to executors; they never read this path.
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "rasterloom"), "zip", _ROOT, "rasterloom")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """fn, after its package has been shipped."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run
