"""Ships this package to Python workers that can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip, served by the driver to all executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "lodestone_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.join("lodestone", os.path.relpath(os.path.join(at, name), top)))
    context.addPyFile(path)
    _shipped[context.applicationId] = path
