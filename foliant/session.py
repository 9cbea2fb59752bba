"""Making this package importable for Spark's Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def share_code(spark: SparkSession) -> None:
    """Put this checkout on the workers' path, wherever the driver was started.

    Executors on other machines need it at the same path, or ``--py-files``.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
