"""Computation in order: runs, overlaps, claims, running offsets, names, versions."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def islands(rows: DataFrame, at: str, partition: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive integers: (partition, start, count). Repeated values count once.

    Without a partition the runs are found bin by bin, and runs that touch a bin's edge are joined over the bins alone.
    """
    d = rows.select(*partition, at).where(F.col(at).isNotNull()).distinct()
    size = 1 << 16
    w = Window.partitionBy(*partition, "_bin").orderBy(at)
    d = d.withColumn("_bin", F.floor(F.col(at) / size)).withColumn("_run", F.col(at) - F.row_number().over(w))
    d = d.groupBy(*partition, "_bin", "_run").agg(F.min(at).alias("start"), F.count("*").alias("count"))
    w = Window.partitionBy(*partition).orderBy("start")
    d = d.withColumn("_new", (F.coalesce(F.lag(F.col("start") + F.col("count")).over(w), F.col("start") - 1) != F.col("start")).cast("int"))
    d = d.withColumn("_island", F.sum("_new").over(w))
    return d.groupBy(*partition, "_island").agg(F.min("start").alias("start"), F.sum("count").alias("count")).drop("_island")


def overlaps_previous(rows: DataFrame, partition: str, start: str, end: str, id_col: str) -> DataFrame:
    """Rows that begin before the one directly before them (by start, then id) ends, with that one's id and the overlap."""
    w = Window.partitionBy(partition).orderBy(start, id_col)
    out = rows.withColumn("previous", F.lag(id_col).over(w)).withColumn("_end", F.lag(end).over(w))
    return out.where(F.col("_end") > F.col(start)).select(partition, id_col, "previous", (F.col("_end") - F.col(start)).alias("overlap"))


def first_claim(claims: DataFrame, item: str, order: Sequence[str], owner: str) -> DataFrame:
    """(item, owner, claims): the owner that claims an item first, and by how many different owners it is claimed.

    One round: a later owner that loses an item keeps its other claims.
    """
    return claims.groupBy(item).agg(F.min_by(owner, F.struct(*order)).alias(owner), F.countDistinct(owner).alias("claims"))


def running_offset(rows: DataFrame, partition: str, order: Sequence[str], count: str) -> DataFrame:
    """rows with offset: the sum of count over the rows before."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(count).over(w), F.lit(0)))


def unique_names(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """rows with unique_name: in order, the name, or with ~2, ~3 ... before its extension the first that no earlier row has got, without regard to case.

    Names that can meet agree in what is left of them without ~ and number; such a group is one sorted run, of which the names given so far are held.
    """
    stem, extension = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    root = F.lower(F.concat(F.regexp_replace(stem, r"( ~[0-9]+)+\z", ""), extension))
    schema = StructType([*rows.schema.fields, StructField("unique_name", StringType())])

    def run(batches):
        root, taken, tried = None, set(), {}
        for batch in batches:
            out = []
            for r, x in zip(batch.column("_root").to_pylist(), batch.column(name).to_pylist(), strict=True):
                if x is None:
                    out.append(None)
                    continue
                if r != root:
                    root, taken, tried = r, set(), {}
                dot, y = x.rfind("."), x
                a, b = (x[:dot], x[dot:]) if dot > 0 else (x, "")
                n = tried.get(x.lower(), 2)
                while y.lower() in taken:
                    y, n = f"{a} ~{n}{b}", n + 1
                tried[x.lower()] = n
                taken.add(y.lower())
                out.append(y)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rows_columns), pa.array(out, pa.string())], names=[*rows_columns, "unique_name"])

    rows_columns = rows.columns
    return rows.withColumn("_root", root).repartition("_root").sortWithinPartitions("_root", *order).mapInArrow(run, schema)


def latest(changes: DataFrame, key: str, version: str, values: Sequence[str]) -> DataFrame:
    """The values of each key's highest version."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), version).alias("_v")).select(key, *[f"_v.{v}" for v in values])


def apply_changes(changes: DataFrame, key: str, version: str, op: str, values: Sequence[str], delete: str) -> DataFrame:
    """What is left when changes are applied in order: the latest row of each key unless it is a deletion."""
    return latest(changes, key, version, [op, *values]).where(F.col(op) != delete).drop(op)


def next_free(used: DataFrame, id_col: str, low: int, high: int) -> DataFrame:
    """One row (next_id): the smallest unused id from low to high, else the largest unused one below low, else null."""
    ids = used.select(F.col(id_col).cast("long").alias("i")).where(f"i between 0 and {high}").distinct()
    runs = islands(ids, "i")
    up = runs.where(f"start <= {low} and start + count > {low}").agg(F.max(F.col("start") + F.col("count")).alias("i"))
    up = up.select(F.coalesce("i", F.lit(low)).alias("i")).where(f"i <= {high}")
    down = runs.where(f"start < {low} and start + count >= {low}").agg(F.min("start").alias("i")).select((F.coalesce("i", F.lit(low)) - 1).alias("i")).where("i >= 0")
    return up.withColumn("p", F.lit(1)).unionByName(down.withColumn("p", F.lit(2))).agg(F.min_by("i", "p").alias("next_id"))
