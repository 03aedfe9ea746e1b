"""This package for executors whose machines do not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives executors this package, for operators whose tasks run its Python code. Once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "foretable_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    bundle = Path(tempfile.mkdtemp(prefix="foretable-")) / "foretable.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(bundle))
    sc.foretable_shipped = True
