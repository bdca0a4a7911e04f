"""Streams: an extension. The change log's fold and windowed counts as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, version: str, values: Sequence[str]) -> DataFrame:
    """The values of each key's highest version so far; for output modes update and complete."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), version).alias("_v")).select(key, *[f"_v.{v}" for v in values])


def windows(events: DataFrame, ts: str, late: str, length: str, keys: Sequence[str], slide: str | None = None) -> DataFrame:
    """Counts in windows of event time; rows later than the watermark are left out."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
