"""Queries of aggregates, integrity checks, ordered computation, interval sets and change logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import checks, ordered, regions
from quarry.plans.tables import EXTENTS_SQL, extents
from quarry.registry import Tables, query


@query("WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, (1 + o_orderkey % 7)::BIGINT AS stored, coalesce(n, 0)::BIGINT AS found FROM orders LEFT JOIN f ON l_orderkey = o_orderkey WHERE 1 + o_orderkey % 7 <> coalesce(n, 0)")
def count_reconcile(t: Tables):
    return checks.reconcile(t.orders.withColumn("stored", 1 + F.col("o_orderkey") % 7), t.lineitem, "o_orderkey", "l_orderkey", "stored")


@query("WITH f AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT n_nationkey, (50 + n_nationkey)::BIGINT AS stored, coalesce(n, 0)::BIGINT AS found FROM nation LEFT JOIN f ON c_nationkey = n_nationkey WHERE 50 + n_nationkey <> coalesce(n, 0)")
def valence_check(t: Tables):
    return checks.reconcile(t.nation.withColumn("stored", 50 + F.col("n_nationkey")), t.customer, "n_nationkey", "c_nationkey", "stored")


@query("SELECT sha256(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t: Tables):
    return checks.duplicates(t.documents, [F.sha2("text", 256).alias("digest")], "doc_id")


@query(f"WITH {EXTENTS_SQL}, l AS (SELECT *, CASE WHEN lag(start + count) OVER (PARTITION BY owner ORDER BY start, count) = start THEN 0 ELSE 1 END AS piece FROM x), g AS (SELECT owner, sum(piece) AS pieces, sum(count) AS blocks FROM l GROUP BY 1) SELECT count(*)::BIGINT AS files, count(*) FILTER (WHERE pieces > 1)::BIGINT AS split, max(pieces)::BIGINT AS most, sum(blocks)::BIGINT AS blocks FROM g")
def fragmentation(t: Tables):
    return checks.fragmentation(extents(t), "owner", "start", "count")


@query(f"WITH {EXTENTS_SQL} SELECT owner, count(DISTINCT b)::BIGINT AS used FROM (SELECT owner, unnest(range(start, start + count)) AS b FROM x) GROUP BY 1")
def bitmap_usage_by_owner(t: Tables):
    return checks.blocks_used(extents(t), "owner", "start", "count")


@query(f"WITH {EXTENTS_SQL} SELECT (b // 4096)::BIGINT AS bucket, count(DISTINCT b)::BIGINT AS used FROM (SELECT unnest(range(start, start + count)) AS b FROM x) GROUP BY 1")
def bitmap_usage(t: Tables):
    spans = extents(t).where("count > 0").groupBy("start").agg(F.max("count").alias("count"))
    blocks = spans.select(F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("b"))
    bits = blocks.withColumn("bucket", F.floor(F.col("b") / 4096)).groupBy("bucket").agg(F.bitmap_count(F.bitmap_construct_agg(F.col("b") % 4096)).alias("used"))
    return bits


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def first_last_per_key(t: Tables):
    return t.events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, l_suppkey, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS k FROM c) WHERE k = 1")
def mode_tiebreak(t: Tables):
    return checks.mode_smallest(t.lineitem, "l_partkey", "l_suppkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_by_priority(t: Tables):
    return checks.keep_lowest_rank(t.orders, "o_custkey", "o_orderpriority", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("SELECT sha256(lower(text)) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def casefold_collisions(t: Tables):
    return checks.duplicates(t.documents, [F.sha2(F.lower("text"), 256).alias("digest")], "doc_id")


@query("SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) % 2 = 1")
def odd_parity(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n % 2 = 1")


@query("WITH d AS (SELECT CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS severity, event_type, user_id, value FROM events) SELECT *, row_number() OVER (ORDER BY severity DESC, event_type)::INT AS position FROM (SELECT severity, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS places FROM d GROUP BY ALL)")
def diag_summary(t: Tables):
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    d = t.events.withColumn("severity", rank).groupBy("severity", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("places"))
    return d.withColumn("position", F.row_number().over(Window.orderBy(F.col("severity").desc(), "event_type")))


@query("SELECT CASE WHEN m >= 3 THEN 'damaged' WHEN m = 2 THEN 'minor problems' WHEN m = 1 THEN 'notes' ELSE 'appears to be OK' END AS verdict, user_id FROM (SELECT user_id, max(CASE WHEN value > 60 THEN CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END ELSE 0 END) AS m FROM events GROUP BY 1)")
def check_verdict(t: Tables):
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return t.events.groupBy("user_id").agg(F.max(F.when(F.col("value") > 60, rank).otherwise(0)).alias("m")).select("user_id", checks.verdict(F.col("m")).alias("verdict"))


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END AS no,
o_orderpriority = '3-MEDIUM' AND o_totalprice > 400000 AS fatal FROM orders) SELECT o_orderkey FROM f WHERE no <= coalesce((SELECT min(no) FROM f WHERE fatal), 99)""")
def stage_stop(t: Tables):
    stages = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    f = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("stage"), F.when((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_totalprice") > 400000), "fatal").otherwise("flag").alias("severity"))
    return checks.run_stages(f, stages).select("o_orderkey")


@query("WITH k AS (SELECT o_orderkey AS b FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)), r AS (SELECT b, b - row_number() OVER (ORDER BY b) AS g FROM k) SELECT min(b) AS start, count(*)::BIGINT AS count FROM r GROUP BY g")
def free_runs(t: Tables):
    free = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return ordered.islands(free, "o_orderkey")


@query("WITH x AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 30 + o_orderkey % 60 AS e FROM orders), l AS (SELECT *, lag(o_orderkey) OVER w AS previous, lag(e) OVER w AS le FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY s, o_orderkey)) SELECT o_custkey, o_orderkey, previous, (le - s)::BIGINT AS overlap FROM l WHERE le > s")
def overlap_prev(t: Tables):
    day = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400)
    return ordered.overlaps_previous(t.orders.withColumn("s", day).withColumn("e", day + 30 + F.col("o_orderkey") % 60), "o_custkey", "s", "e", "o_orderkey")


@query("SELECT l_partkey, arg_min(l_orderkey, l_orderkey) AS l_orderkey, count(DISTINCT l_orderkey)::BIGINT AS claims FROM lineitem GROUP BY 1")
def first_claimer(t: Tables):
    return ordered.first_claim(t.lineitem, "l_partkey", ["l_orderkey"], "l_orderkey")


@query(f"WITH {EXTENTS_SQL}, o AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY owner ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x) SELECT owner, start, off::BIGINT AS offset, (start - off)::BIGINT AS gap FROM o")
def running_offset_gap(t: Tables):
    d = ordered.running_offset(extents(t), "owner", ["start"], "count")
    return d.select("owner", "start", "offset", (F.col("start") - F.col("offset")).alias("gap"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL)")
def current_parent(t: Tables):
    c = t.conversations.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("parent"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE o_orderdate <= before")
def key_order(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.withColumn("before", F.lag("o_orderdate").over(w)).where("o_orderdate <= before").select("o_custkey", "o_orderkey")


@query("WITH u AS (SELECT DISTINCT l_orderkey AS i FROM lineitem) SELECT coalesce((SELECT min(c.i) FROM (SELECT unnest(range(128, 32768)) AS i) c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.i = c.i)), (SELECT max(c.i) FROM (SELECT unnest(range(0, 128)) AS i) c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.i = c.i)))::BIGINT AS next_id")
def next_free_id(t: Tables):
    """Every line's order as a used id: the gaps are the orders without lines."""
    return ordered.next_free(t.lineitem, "l_orderkey", 128, 32767)


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE regexp_extract(p_name, '^(.*?)(\\.[^.]*)?$', 1) || ' ~' || n || regexp_extract(p_name, '^(.*?)(\\.[^.]*)?$', 2) END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part)")
def unique_names(t: Tables):
    return ordered.unique_names(t.part, "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_version(t: Tables):
    return ordered.latest(t.events, "user_id", "event_id", ["event_type", "value"])


@query("WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY 1) SELECT user_id, value FROM l WHERE op <> 'error'")
def apply_changes(t: Tables):
    return ordered.apply_changes(t.events, "user_id", "event_id", "event_type", ["value"], "error")


@query("WITH RECURSIVE d AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM d)")
def remove_subtree(t: Tables):
    from quarry.operators.changes import remove
    from quarry.plans.tables import entries

    left = remove(entries(t), "r1", 4)
    return left.where("kind = 'file'").select(F.substring("id", 2, 20).cast("long").alias("c_custkey"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 200000) DESC, o_orderkey))::INT AS position FROM orders")
def sort_multi(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.abs(F.col("o_totalprice") - 200000).desc(), "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).alias("position"))


@query("SELECT p_brand, arg_min(p_partkey, (abs(p_size - 12), p_partkey)) AS p_partkey FROM part GROUP BY 1")
def nearest_value(t: Tables):
    return t.part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(F.abs(F.col("p_size") - 12), "p_partkey")).alias("p_partkey"))


def _spans(t: Tables, kind: str):
    s = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("long")
    return t.events.where(F.col("event_type") == kind).select("user_id", s.alias("low"), (s + 60 + F.col("event_id") % 600).alias("high"))


_RULES = {"union": "a > 0 OR b > 0", "intersect": "a > 0 AND b > 0", "difference": "a > 0 AND b = 0", "xor": "(a > 0) <> (b > 0)"}
for _rule, _when in _RULES.items():
    query(
        f"""WITH s AS (SELECT user_id, event_type, floor(epoch(ts) / 60)::BIGINT AS low, floor(epoch(ts) / 60)::BIGINT + 60 + event_id % 600 AS high FROM events WHERE event_type IN ('view', 'click')),
q AS (SELECT user_id, low AS x, (event_type = 'view')::INT AS a, (event_type = 'click')::INT AS b FROM s UNION ALL SELECT user_id, high, -(event_type = 'view')::INT, -(event_type = 'click')::INT FROM s),
g AS (SELECT user_id, x, sum(a) AS a, sum(b) AS b FROM q GROUP BY ALL), r AS (SELECT user_id, x, sum(a) OVER w AS a, sum(b) OVER w AS b FROM g WINDOW w AS (PARTITION BY user_id ORDER BY x)),
o AS (SELECT user_id, x, {_when} AS f FROM r), c AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY x), FALSE) AS p FROM o),
n AS (SELECT user_id, x AS low, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS high, f FROM c WHERE f <> p) SELECT user_id, low, high FROM n WHERE f""",
        name=f"region_{_rule}",
    )(lambda t, rule=_rule: regions.combine(_spans(t, "view"), _spans(t, "click"), "user_id", rule))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM (CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END) THEN 1 WHEN o_orderpriority IS DISTINCT FROM (CASE WHEN o_orderkey % 4 = 0 THEN '5-LOW' ELSE o_orderpriority END) THEN 2 ELSE 0 END AS detail FROM orders")
def first_difference(t: Tables):
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.select(k, checks.first_difference([(s, F.when(k % 3 == 0, "F").otherwise(s)), (p, F.when(k % 4 == 0, "5-LOW").otherwise(p))]).alias("detail"))
