"""The package on the executors of a session that hasn't installed it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a Spark context: Python workers import it from there.
    The archive stays as long as the driver, as executors that join later fetch it too."""
    sc = spark.sparkContext
    if getattr(sc, "_loam_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="loam-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "loam.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._loam_shipped = True
