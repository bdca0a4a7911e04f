"""Integrity rules of a volume as queries over its tables (quarry.sources.hfs.tables): each gives findings, none reads bytes.

Findings: volume, stage, severity ('fatal', 'flag', 'note'), code, detail. Stages stop after a fatal finding, per volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.browse import MAX_DEPTH

STAGES = ["volume", "catalog", "hierarchy", "extents", "counts"]
FIRST_USER_ID = 16
#: How far the stored next id may run ahead before it counts as wrong.
ID_SLACK = 4096


def _found(df: DataFrame, stage: str, severity: str, code: str, detail: Column) -> DataFrame:
    return df.select("volume", F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def check(volumes: DataFrame, records: DataFrame, extents: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """All findings, those of stages after a volume's first fatal one left out."""
    folders, files = records.where("kind = 'folder'"), records.where("kind = 'file'")
    threads = records.where("kind = 'folder thread'")
    found = [_found(volumes.where((F.col("block_size") % 512 != 0) | (F.col("block_size") == 0)), "volume", "fatal", "bad block size", F.col("block_size"))]
    found.append(_found(volumes.where(F.size("notes") > 0), "catalog", "flag", "unreadable part", F.array_join("notes", "; ")))

    ids = folders.unionByName(files)
    found.append(_found(ids.groupBy("volume", "id").agg(F.count("*").alias("n")).where("n > 1"), "catalog", "flag", "id used twice", F.col("id")))
    found.append(_found(ids.where((F.col("id") < FIRST_USER_ID) & (F.col("id") != 2)), "catalog", "flag", "reserved id", F.col("id")))
    found.append(_found(folders.join(threads.select("volume", "id"), ["volume", "id"], "left_anti"), "catalog", "flag", "folder without thread", F.col("id")))
    found.append(_found(threads.join(folders.select("volume", "id"), ["volume", "id"], "left_anti"), "catalog", "flag", "thread without folder", F.col("id")))
    order = Window.partitionBy("volume").orderBy("ordinal")
    keys = records.where("kind in ('folder', 'file')").withColumn("_key", F.struct("parent", F.lower("name"))).withColumn("_before", F.lag("_key").over(order))
    found.append(_found(keys.where(F.col("_key.parent") < F.col("_before.parent")), "catalog", "flag", "keys out of order", F.col("ordinal")))

    orphans = ids.where("parent <> 1").join(folders.select("volume", F.col("id").alias("parent")), ["volume", "parent"], "left_anti")
    found.append(_found(orphans, "hierarchy", "flag", "parent is missing", F.col("id")))
    known, reach = folders.select("volume", "id", F.col("parent").alias("above"), F.lit(1).alias("distance")), 1
    while reach < depth:  # pointer doubling: who stands exactly reach levels above
        far = known.alias("a").join(known.alias("b"), (F.col("a.volume") == F.col("b.volume")) & (F.col("a.above") == F.col("b.id")))
        known, reach = far.select("a.volume", "a.id", "b.above", (F.col("a.distance") + F.col("b.distance")).alias("distance")), 2 * reach
    found.append(_found(known, "hierarchy", "fatal", f"nesting of {reach} levels or a loop", F.col("id")))
    inside = ids.groupBy("volume", F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    valence = folders.join(inside, ["volume", "id"], "left").where(F.col("valence") != F.coalesce("n", F.lit(0)))
    found.append(_found(valence, "hierarchy", "flag", "wrong number of items in folder", F.concat_ws(" ", "id", "valence", F.coalesce("n", F.lit(0)))))

    e = extents.join(volumes.select("volume", "blocks"), "volume")
    found.append(_found(e.where("start + count > blocks"), "extents", "flag", "extent past the end", F.concat_ws(" ", "file", "start", "count")))
    found.append(_found(e.where("fork like 'orphan%'"), "extents", "flag", "overflow extent without file", F.col("file")))
    by_start = Window.partitionBy("volume").orderBy("start", "file", "fork", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    overlap = e.withColumn("_end", F.max(F.col("start") + F.col("count")).over(by_start)).where("_end > start")
    found.append(_found(overlap, "extents", "flag", "overlapping extents", F.concat_ws(" ", "file", "start")))
    held = e.groupBy("volume", "file", "fork").agg(F.sum("count").alias("n"))
    sizes = files.select("volume", F.col("id").alias("file"), F.explode(F.array(F.struct(F.lit("data").alias("fork"), F.col("data_size").alias("size")), F.struct(F.lit("resource").alias("fork"), F.col("resource_size").alias("size")))).alias("f")).select("volume", "file", "f.*")
    short = sizes.join(held, ["volume", "file", "fork"], "left").join(volumes.select("volume", "block_size"), "volume").where("size > coalesce(n, 0) * block_size")
    found.append(_found(short, "extents", "flag", "fork is longer than its extents", F.concat_ws(" ", "file", "fork")))

    n = records.groupBy("volume").agg(F.count_if((F.col("kind") == "file")).alias("nf"), F.count_if((F.col("kind") == "folder") & (F.col("parent") != 1)).alias("nd"), F.count_if((F.col("kind") == "file") & (F.col("parent") == 2)).alias("nr"), F.max("id").alias("top"))
    v = volumes.join(n, "volume", "left")
    for code, stored, real in (("file count", "files", "nf"), ("folder count", "folders", "nd"), ("root file count", "root_files", "nr")):
        found.append(_found(v.where(F.col(stored) != F.coalesce(real, F.lit(0))), "counts", "note", f"wrong {code}", F.concat_ws(" ", stored, real)))
    found.append(_found(v.where("free <> blocks - used"), "counts", "note", "wrong free blocks", F.concat_ws(" ", "free", F.col("blocks") - F.col("used"))))
    found.append(_found(v.where((F.col("next_id") <= F.col("top")) | (F.col("next_id") > F.col("top") + 1 + ID_SLACK)), "counts", "note", "wrong next id", F.concat_ws(" ", "next_id", "top")))

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    number = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    stop = F.min(F.when(F.col("severity") == "fatal", number)).over(Window.partitionBy("volume"))
    return every.withColumn("_stop", stop).where(F.col("_stop").isNull() | (number <= F.col("_stop"))).drop("_stop")
