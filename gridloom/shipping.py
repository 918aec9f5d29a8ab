"""Gives executors this package, for functions that run in Python workers there."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of this application, once, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here, to = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="gridloom-")
        shutil.copytree(here, Path(to, "zip", here.name), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(to, here.name), "zip", os.path.join(to, "zip")))
        _shipped.add(context.applicationId)
