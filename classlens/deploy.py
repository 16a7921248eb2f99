"""Sending the package to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package: Python functions that run there name its modules.

    Needed once per session where the package is not installed on the executors. Spark copies the archive to them.
    """
    application = spark.sparkContext.applicationId
    if application in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="classlens-")
    path = os.path.join(folder, "classlens.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for base, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _sent.add(application)
