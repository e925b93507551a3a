"""Giving the package to the executors: closures that run there import it."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_lock = threading.Lock()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application."""
    app = spark.sparkContext.applicationId
    with _lock:
        if app in _shipped:
            return
        root = Path(__file__).resolve().parent
        out = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_code.zip")
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(out)
        _shipped.add(app)
