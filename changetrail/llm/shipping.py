"""Sends this package to the executors, so that tasks can import it wherever the driver runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import changetrail

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Adds the package as a Python file of the application, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(changetrail.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="changetrail-code-"), "changetrail.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
