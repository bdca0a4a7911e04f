"""Edits of a catalog as rows: each gives the catalog's next state; a log of them with a pointer gives undo and redo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.browse import MAX_DEPTH, ancestors


def remove(entries: DataFrame, id_: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Without an entry and all that is below it."""
    gone = ancestors(entries, depth).where(F.col("ancestor") == id_).select("id")
    return entries.join(gone, "id", "left_anti")


def rename(entries: DataFrame, id_: str, name: str) -> DataFrame:
    return entries.withColumn("name", F.when(F.col("id") == id_, name).otherwise(F.col("name")))


def move(entries: DataFrame, id_: str, parent: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Below another entry; unchanged where that one is the entry itself, lies below it or does not exist."""
    inside = ancestors(entries, depth).where((F.col("id") == parent) & (F.col("ancestor") == id_)).select(F.lit(True).alias("_in")).limit(1)
    there = entries.where(F.col("id") == parent).select(F.lit(True).alias("_there")).limit(1)
    e = entries.join(F.broadcast(inside), F.lit(True), "left").join(F.broadcast(there), F.lit(True), "left")  # one row each
    ok = F.col("_in").isNull() & F.col("_there").isNotNull()
    return e.withColumn("parent", F.when((F.col("id") == id_) & ok, parent).otherwise(F.col("parent"))).drop("_in", "_there")


def put(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """With rows added; those of an id that is there already take its place."""
    return entries.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def at_position(log: DataFrame, position: int, key: str, version: str, op: str, values: list[str], delete: str) -> DataFrame:
    """The state after the first position changes of a log: undo and redo move the position."""
    from quarry.operators.ordered import apply_changes

    return apply_changes(log.where(F.col(version) <= position), key, version, op, values, delete)
