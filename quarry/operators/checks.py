"""Reconciliation and integrity checks: counts against stored counts, duplicates, first per key, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(owners: DataFrame, members: DataFrame, key: str, member_key: str, stored: str) -> DataFrame:
    """Owners whose stored count is not the number of their members: (key, stored, found)."""
    found = members.groupBy(F.col(member_key).alias(key)).agg(F.count("*").alias("found"))
    return owners.join(found, key, "left").select(key, F.col(stored).cast("long").alias("stored"), F.coalesce("found", F.lit(0)).alias("found")).where("stored <> found")


def duplicates(rows: DataFrame, keys: Sequence[str | Column], id_col: str) -> DataFrame:
    """Keys that occur more than once: (keys, n, first), first being the smallest id."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_col).alias("first")).where("n > 1")


def fragmentation(extents: DataFrame, owner: str, start: str, count: str) -> DataFrame:
    """One row: files, split files (more than one extent that does not join the one before), most extents, blocks in all."""
    w = Window.partitionBy(owner).orderBy(start, count)
    joined = (F.lag(F.col(start) + F.col(count)).over(w) == F.col(start)).cast("int")
    pieces = extents.withColumn("_new", 1 - F.coalesce(joined, F.lit(0))).groupBy(owner).agg(F.sum("_new").alias("pieces"), F.sum(count).alias("blocks"))
    return pieces.agg(F.count("*").alias("files"), F.count_if(F.col("pieces") > 1).alias("split"), F.max("pieces").cast("long").alias("most"), F.sum("blocks").cast("long").alias("blocks"))


def blocks_used(extents: DataFrame, owner: str, start: str, count: str) -> DataFrame:
    """(owner, used): how many different blocks an owner's extents hold. Extents that overlap count once, empty ones don't; no extent is opened into blocks."""
    end = F.col(start) + F.col(count)
    before = F.max(end).over(Window.partitionBy(owner).orderBy(start, count).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(end - F.greatest(F.col(start), F.coalesce(before, F.col(start))), F.lit(0))
    return extents.where(F.col(count) > 0).withColumn("_fresh", fresh).groupBy(owner).agg(F.sum("_fresh").cast("long").alias("used"))


def first_difference(fields: Sequence[tuple[Column, Column]]) -> Column:
    """The number (from 1) of the first pair that differs, nulls being values; 0 where none does."""
    out = None
    for i, (a, b) in enumerate(fields, 1):
        out = F.when(~a.eqNullSafe(b), i) if out is None else out.when(~a.eqNullSafe(b), i)
    return (F.lit(0) if out is None else out.otherwise(0)).cast("int")


def mode_smallest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equally frequent ones: (key, value, n)."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("_b")).select(key, f"_b.{value}", "_b.n")


def keep_lowest_rank(rows: DataFrame, key: str, rank: str, ordinal: str, values: Sequence[str]) -> DataFrame:
    """For each key the values of the row of the lowest rank, the first by ordinal on ties."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(rank, ordinal)).alias("_b"))
    return best.select(key, *[f"_b.{v}" for v in values])


def verdict(worst: Column) -> Column:
    """What a check says in the end, from the highest severity number met (null: none)."""
    return F.when(worst >= 3, "damaged").when(worst == 2, "minor problems").when(worst == 1, "notes").otherwise("appears to be OK")


def run_stages(findings: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Findings of the stages up to the first that has a fatal one, that stage included: a fatal finding stops what follows."""
    number = F.coalesce(*[F.when(F.col("stage") == s, F.lit(i)) for i, s in enumerate(stages, 1)])
    f = findings.withColumn("_no", number)
    stop = f.where("severity = 'fatal'").agg(F.min("_no").alias("_stop"))  # one row
    return f.crossJoin(F.broadcast(stop)).where("_stop is null or _no <= _stop").drop("_no", "_stop")
