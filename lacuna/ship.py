"""Sends the package to executors whose Python does not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; nothing to do where workers inherit a path that has the package."""
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _shipped or ROOT in [*paths, Path.cwd().resolve()]:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="lacuna-"), "lacuna.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted([*ROOT.glob("lacuna/**/*.py"), *ROOT.glob("*.py")]):
            archive.write(file, file.relative_to(ROOT))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
