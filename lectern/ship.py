"""Sending the package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per session; workers that can import it already are not disturbed."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_sent", False):
        return
    path = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, str(p.relative_to(HERE.parent)))
    sc.addPyFile(str(path))
    sc._lectern_sent = True
