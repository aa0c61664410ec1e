"""Sending this package's sources to Python workers that don't have it installed."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    target = os.path.join(folder, f"{PACKAGE.name}_src.zip")
    Path(target).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
