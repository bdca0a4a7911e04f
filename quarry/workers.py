"""Lets Python workers import this package wherever the driver found it, and bounds what they are sent at a time."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

#: Rows and bytes an Arrow batch holds at most, as in the corpus operators: a Python worker holds two batches and what a function makes of one, and Spark's 10,000 rows may be whole texts.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """On a cluster the package is installed or sent with --py-files; the path does no harm there. Keeps Arrow batches small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark
