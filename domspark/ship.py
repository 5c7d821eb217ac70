"""Sends this package to the executors, which may not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's modules, added to the executors' paths by Spark."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="domspark-")) / "domspark.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, f"{here.name}/{path.relative_to(here)}")
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
