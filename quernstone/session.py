"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the session's Python workers, wherever they run; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_quernstone_shipped", False):
        return spark
    root = Path(__file__).parent
    # sc serves the file to the executors; only the driver reads it here
    path = os.path.join(tempfile.mkdtemp(prefix="quernstone-"), "quernstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._quernstone_shipped = True
    return spark
