"""Sends this package to the executors, for sessions that were not started with it on their Python path."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a py-file once per application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        staged = Path(folder, "staged")
        shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(), package.name)), "zip", staged)
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
