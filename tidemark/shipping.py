"""Makes this package importable in Python workers, which need not share the driver's folders."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    sc.addPyFile(path)
    sc._tidemark_shipped = True
