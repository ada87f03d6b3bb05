"""Sends the package to the executors where PYTHONPATH does not already lead to it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; executors fetch the archive from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="wakeline-"), "wakeline_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((_ROOT / "wakeline").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
