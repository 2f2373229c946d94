"""Sends this package to the executors, for functions that run there in Python."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per application: the package's sources as a file that every executor fetches."""
    sc = spark.sparkContext
    if getattr(sc, "_turnloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    out = os.path.join(tempfile.mkdtemp(prefix="ship"), "turnloom_src.zip")
    Path(out).write_bytes(buf.getvalue())
    sc.addPyFile(out)
    sc._turnloom_shipped = True
