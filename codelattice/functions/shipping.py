"""Handing this package to the executors' Python."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the executors' path, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        own = tempfile.mkdtemp(prefix="code-")  # Spark serves the archive from here to whatever executor starts later
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        made = shutil.make_archive(f"{own}/{package.name}_code", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)
