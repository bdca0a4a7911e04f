"""Joins: prioritised lookups, covering runs, overlaps, snapshots, bounded chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Which keys stand on either side alone, or on both: (key, side)."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both").alias("side"))


def fallback(rows: DataFrame, table: DataFrame, key: str, sub: str, value: str) -> DataFrame:
    """rows with value: that of (key, sub), else that of (key, null) in table (unique per key and sub)."""
    exact = table.where(F.col(sub).isNotNull()).select(key, sub, F.col(value).alias("_exact"))
    any_ = table.where(F.col(sub).isNull()).select(key, F.col(value).alias("_any"))
    return rows.join(exact, [key, sub], "left").join(any_, key, "left").withColumn(value, F.coalesce("_exact", "_any")).drop("_exact", "_any")


def by_priority(candidates: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """For each key one row: of the first candidate list that has any, the first by order. Adds strategy (from 1)."""
    every = None
    for i, c in enumerate(candidates, 1):
        c = c.withColumn("strategy", F.lit(i))
        every = c if every is None else every.unionByName(c)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("strategy", *order))
    return every.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def longest_suffix(rows: DataFrame, text: str, suffixes: Sequence[str]) -> DataFrame:
    """rows with suffix: the longest of the suffixes that text ends with, the earlier on ties, null without any."""
    ranked = sorted(suffixes, key=lambda s: -len(s))
    return rows.withColumn("suffix", F.coalesce(*[F.when(F.lower(text).endswith(s.lower()), F.lit(s)) for s in ranked]))


def as_of(points: DataFrame, runs: DataFrame, key: str, at: str, start: str, values: Sequence[str]) -> DataFrame:
    """points with the values of the last run of their key that starts at or before them (at = start counts), the first run's where none does.

    One sort of both sides together; nothing is joined.
    """
    none = [F.lit(None).cast(runs.schema[v].dataType).alias(v) for v in values]
    extra = [c for c in points.columns if c not in (key, at)]
    a = points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), *extra, *none)
    b = runs.select(key, F.col(start).alias("_at"), F.lit(0).alias("_side"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra], *values)
    run = F.when(F.col("_side") == 0, F.struct(*values))
    w = Window.partitionBy(key).orderBy("_at", "_side")
    found = F.coalesce(F.last(run, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(run, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    out = a.unionByName(b).withColumn("_run", found).where("_side = 1")
    return out.select(key, F.col("_at").alias(at), *extra, *[F.col(f"_run.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, count: str, bin_size: int) -> DataFrame:
    """points inside [start, start + count): both sides are binned, so that the join has an equal key."""
    binned = ranges.where(F.col(count) > 0).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(start) + F.col(count) - 1) / bin_size))))
    return points.withColumn("_bin", F.floor(F.col(at) / bin_size)).join(binned, "_bin").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(count))).drop("_bin")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, change) of keys that were added, removed or changed; nulls are values."""
    a = before.select(key, F.struct(*values).alias("_a"))
    b = after.select(key, F.struct(*values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def follow(edges: DataFrame, source: str, target: str, hops: int) -> DataFrame:
    """From each source along its (one) target for at most hops steps: (source, last, hops, looped). A node met twice ends the walk."""
    e = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    walk = edges.select(F.col(source).alias("source"), F.array(source).alias("seen"), F.lit(False).alias("looped"))
    for _ in range(hops):
        nxt = walk.join(e, F.element_at("seen", -1) == F.col("_from"), "left")
        loops = F.col("looped") | F.coalesce(F.array_contains("seen", F.col("_to")), F.lit(False))
        walk = nxt.select("source", F.when(loops | F.col("_to").isNull(), F.col("seen")).otherwise(F.concat("seen", F.array("_to"))).alias("seen"), loops.alias("looped"))
    return walk.select("source", F.element_at("seen", -1).alias("last"), (F.size("seen") - 1).cast("long").alias("hops"), "looped")


def kind_of(outcomes: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The first outcome whose condition holds."""
    out = None
    for condition, value in outcomes:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)
