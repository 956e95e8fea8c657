"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once a session, unless PYTHONPATH already leads to it."""
    context = spark.sparkContext
    if context.applicationId in _shipped or str(ROOT) in map(os.path.realpath, os.environ.get("PYTHONPATH", "").split(":")):
        return
    folder = tempfile.mkdtemp(prefix="skirmish-")
    context.addPyFile(shutil.make_archive(f"{folder}/skirmish", "zip", ROOT, "skirmish"))
    _shipped.add(context.applicationId)
