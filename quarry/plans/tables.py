"""The driver's tables seen as catalog, extents and claims: the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.registry import Tables


def entries(t: Tables, orders: bool = False) -> DataFrame:
    """region > nation > customer (> orders) as entries of a catalog."""
    none = F.lit(None).cast("string")
    e = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), none.alias("parent"), F.lit("folder").alias("kind"), F.col("r_name").alias("name"), none.alias("type"), F.lit(None).cast("double").alias("size"), F.lit(0).alias("depth"))
    e = e.unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("folder").alias("kind"), F.col("n_name").alias("name"), none.alias("type"), F.lit(None).cast("double").alias("size"), F.lit(1).alias("depth")))
    kind = "container" if orders else "file"
    e = e.unionByName(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.lit(kind).alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("size"), F.lit(2).alias("depth")))
    if orders:
        e = e.unionByName(t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent"), F.lit("file").alias("kind"), F.concat(F.lit("Order#"), "o_orderkey").alias("name"), F.col("o_orderstatus").alias("type"), F.col("o_totalprice").alias("size"), F.lit(3).alias("depth")))
    return e


#: The same entries in SQL: customers are files.
ENTRIES_SQL = """
e AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, 'folder' AS kind, r_name AS name, NULL::VARCHAR AS type, NULL::DOUBLE AS size, 0 AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'folder', n_name, NULL, NULL, 1 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'file', c_name, c_mktsegment, c_acctbal, 2 FROM customer)"""

#: With orders: customers are containers.
DEEP_SQL = ENTRIES_SQL.replace("'file'", "'container'")[:-1] + """
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'file', 'Order#' || o_orderkey, o_orderstatus, o_totalprice, 3 FROM orders)"""


def extents(t: Tables) -> DataFrame:
    """One extent per order and part: it starts at the part's key and has as many blocks as pieces were ordered."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("start")).agg(F.sum("l_quantity").cast("long").alias("count"))


EXTENTS_SQL = "x AS (SELECT l_orderkey AS owner, l_partkey AS start, sum(l_quantity)::BIGINT AS count FROM lineitem GROUP BY ALL)"
