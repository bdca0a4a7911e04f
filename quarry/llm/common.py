"""Shared plumbing of the corpus operators: session setup, shared scratch tables, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])

#: Rows an Arrow batch holds at most. Texts reach 120 kB and more, so the default of 10,000 rows could reach a GB.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, REPO])
    env.setdefault("OMP_NUM_THREADS", "1")
    env.setdefault("OPENBLAS_NUM_THREADS", "1")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; a temporary one only where that is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and no executor's loss undoes it."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column has them (whatever the case of its letters)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The size rows (word, n) of the largest n, ties to the smaller word. A histogram of n by eighths of powers of two says which rows may be among them, so
    that the last sort sees little more than size rows."""
    step = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)  # 512 rows at most
    least, held = 0, 0
    for level, n in levels:
        least, held = level, held + n
        if held >= size:
            break
    return counts.where(step >= least).orderBy(F.col("n").desc(), "word").limit(size)


def components(edges: DataFrame, folder: str, name: str = "cc", rounds: int = 400) -> DataFrame:
    """Connected components by alternating large-star and small-star joins.

    edges: columns a, b of one orderable type. Returns (node, component), component being the smallest node reachable;
    nodes without an edge to another node are left out. Each round joins every edge once with one row per node, so a
    node of any degree costs no more than its edges; a round's edges are a written table. Empty input: empty result.
    """
    spark = edges.sparkSession
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = table(e, folder, f"{name}-0")

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        return r[0], r[1]

    now = mark(e)
    for k in range(1, rounds + 1):
        if not now[0]:
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large.where("u <> v").distinct(), folder, f"{name}-{k}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = table(small.where("u <> v").distinct(), folder, f"{name}-{k}")
        was, now = now, mark(e)
        drop(spark, folder, f"{name}-{k}l")
        drop(spark, folder, f"{name}-{k - 1}")
        if now == was:
            break
    else:
        raise RuntimeError(f"components: no fixpoint after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
