"""The package on the executors: sent along where their Python would not find it by itself."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's context, once; nothing if Python workers inherit a path to them."""
    here = os.path.dirname(os.path.abspath(__file__))
    root, app = os.path.dirname(here), spark.sparkContext.applicationId
    found = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if app in _SENT or root in found:
        return
    at = os.path.join(tempfile.mkdtemp(), "rateline.zip")
    with zipfile.ZipFile(at, "w") as out:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    out.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    spark.sparkContext.addPyFile(at)  # served by the driver to every executor
    _SENT.add(app)
