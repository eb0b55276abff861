"""Sends this package to the executors, so that Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Once a Spark context, unless the workers' PYTHONPATH already leads to the package."""
    sc = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or getattr(sc, "_mediaquarry_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="mq-ship-")) / "mediaquarry.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted((ROOT / "mediaquarry").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(at))
    sc._mediaquarry_shipped = True
