"""Sends this package to the executors where they could not import it otherwise."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: nothing where workers start in the package's folder or have it on PYTHONPATH."""
    here = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SENT or ROOT in [os.path.abspath(p) for p in here if p]:
        return
    zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "kithgraph"), "zip", ROOT, "kithgraph")
    spark.sparkContext.addPyFile(zipped)
    _SENT.add(app)
