"""The table of types and creators: tab-separated text, '#' lines before the header being comments; after it, '#' is a character like others."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "type string, creator string, kind string, ordinal bigint"


def parse(text: str) -> list[tuple[str, str | None, str, int]]:
    """(type, creator or null for any, kind, ordinal); lines without a type or a kind are left out."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    while lines and (lines[0].startswith("#") or not lines[0].strip()):
        lines.pop(0)
    if not lines:
        return []
    at = {name.strip().lower(): i for i, name in enumerate(lines[0].split("\t"))}
    out = []
    for n, line in enumerate(lines[1:]):
        f = line.split("\t")
        get = lambda k: f[at[k]] if k in at and at[k] < len(f) else ""  # noqa: E731, B023
        if get("type") and get("kind").strip():
            out.append((get("type"), get("creator") or None, get("kind").strip(), n))
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the tables below a path; a file is read as a whole, since its first lines decide what the others are."""

    def run(batches):
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() for r in parse(t or "")]
            yield pa.RecordBatch.from_pylist([dict(zip(("type", "creator", "kind", "ordinal"), r, strict=True)) for r in rows], schema=pa.schema([("type", pa.string()), ("creator", pa.string()), ("kind", pa.string()), ("ordinal", pa.int64())]))

    return spark.read.text(path, wholetext=True).mapInArrow(run, SCHEMA)
