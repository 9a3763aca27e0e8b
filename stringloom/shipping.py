"""Puts this package where Python workers find it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="stringloom-")  # on the driver only; Spark serves the file
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / "stringloom.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
