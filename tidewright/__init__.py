"""Corpus-to-retrieval data jobs on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors with Spark's addPyFile, once an application, unless their
    PYTHONPATH has it already."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="tidewright-")) / "tidewright.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
