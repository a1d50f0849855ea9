"""Spark-native full-text pattern search and sequence analytics."""

from __future__ import annotations

import os
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is shipped with ``--py-files``; there the extra
    search path is simply one that does not exist.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
