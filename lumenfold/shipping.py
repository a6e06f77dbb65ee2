"""Makes the package importable in Python workers, however the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_lumenfold_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lumenfold-"), "lumenfold.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name, p.relative_to(root)).as_posix())
    context.addPyFile(archive)
    context._lumenfold_shipped = True
