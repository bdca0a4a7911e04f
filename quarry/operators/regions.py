"""Set algebra of interval sets: one sweep over the edges of both sides, partitioned by key; no pair of intervals is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULES = {"union": "a > 0 or b > 0", "intersect": "a > 0 and b > 0", "difference": "a > 0 and b = 0", "xor": "(a > 0) <> (b > 0)"}


def combine(left: DataFrame, right: DataFrame, key: str, rule: str) -> DataFrame:
    """(key, low, high) of the half-open intervals where the rule holds, touching ones merged. Inputs: key, low, high; empty ones don't count."""

    def edges(df: DataFrame, a: int, b: int) -> DataFrame:
        e = F.explode(F.array(F.struct(F.col("low").alias("x"), F.lit(1).alias("s")), F.struct(F.col("high").alias("x"), F.lit(-1).alias("s"))))
        return df.where("low < high").select(key, e.alias("e")).select(key, "e.x", (F.col("e.s") * a).alias("a"), (F.col("e.s") * b).alias("b"))

    e = edges(left, 1, 0).unionByName(edges(right, 0, 1)).groupBy(key, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(key).orderBy("x")
    e = e.select(key, "x", F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
    e = e.withColumn("on", F.expr(RULES[rule])).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on <> was")
    e = e.withColumn("high", F.lead("x").over(Window.partitionBy(key).orderBy("x")))
    return e.where("on").select(key, F.col("x").alias("low"), "high")
