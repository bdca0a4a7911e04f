"""Limits that say whether more would have matched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limited(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in order, each with truncated: whether there were more. Only n + 1 rows leave the sort."""
    some = df.orderBy(*order).limit(n + 1)
    return some.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > n).where(F.col("_n") <= n).drop("_n")
