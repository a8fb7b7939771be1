"""This package for executors, where Python code of it runs there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Not needed, and not done, where it came in an archive (``--py-files``) already.
    """
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if spark.sparkContext.applicationId in _shipped or not os.path.isdir(package):
        return
    _shipped.add(spark.sparkContext.applicationId)
    archive = os.path.join(tempfile.mkdtemp(prefix="braidflow-"), "braidflow.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
