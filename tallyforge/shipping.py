"""Sends this package to the Python workers, so that a plain SparkSession can run every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once an application, and bounds the batches that workers are sent."""
    # Python workers get their rows in small batches: memory is theirs by the batch, whatever the length of a text
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tallyforge-code-"), "tallyforge.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(here.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                out.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
