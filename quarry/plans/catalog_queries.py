"""Queries of catalog browsing, lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import browse, lookups
from quarry.plans.tables import DEEP_SQL, ENTRIES_SQL, EXTENTS_SQL, entries, extents
from quarry.registry import Tables, query

FLAGS = {1: "on desk", 2: "shared", 4: "inited", 8: "locked", 16: "bundle", 32: "invisible"}


@query(f"WITH {ENTRIES_SQL} SELECT id, kind, name FROM e WHERE parent = 'r1'")
def ls_children(t: Tables):
    return browse.children(entries(t), "r1").select("id", "kind", "name")


@query(f"WITH {ENTRIES_SQL} SELECT id, kind, name, type, CASE WHEN kind = 'file' THEN size END AS size, CASE WHEN kind = 'folder' THEN (SELECT count(*) FROM e c WHERE c.parent = e.id) END::BIGINT AS children FROM e")
def entry_info(t: Tables):
    e = entries(t)
    n = e.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    return e.join(n, "id", "left").select("id", "kind", "name", "type", F.when(F.col("kind") == "file", F.col("size")).alias("size"), F.when(F.col("kind") == "folder", F.coalesce("n", F.lit(0))).alias("children"))


@query("SELECT n_nationkey, n_name, count(c_custkey)::BIGINT AS children, count(*) FILTER (WHERE c_acctbal < 0)::BIGINT AS negative, round(sum(c_acctbal), 2) AS total FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def stat_counts(t: Tables):
    j = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("children"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT p_partkey, concat_ws(', ', " + ", ".join(f"CASE WHEN p_size & {b} <> 0 THEN '{n}' END" for b, n in FLAGS.items()) + ") AS flags FROM part")
def flag_names(t: Tables):
    return t.part.select("p_partkey", F.array_join(browse.flag_names(F.col("p_size"), FLAGS), ", ").alias("flags"))


@query(f"WITH RECURSIVE {ENTRIES_SQL}, p AS (SELECT id, name AS path, 0::BIGINT AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, p.path || ':' || e.name, p.depth + 1 FROM e JOIN p ON e.parent = p.id) SELECT * FROM p")
def path_tree(t: Tables):
    return browse.paths(entries(t), 4)


@query(f"WITH RECURSIVE {DEEP_SQL}, p AS (SELECT id, kind, [name] AS chain, 0 AS depth, 0 AS levels FROM e WHERE parent IS NULL UNION ALL SELECT e.id, e.kind, list_append(p.chain, e.name), p.depth + 1, p.levels + (p.kind = 'container')::INT FROM e JOIN p ON e.parent = p.id) SELECT id, array_to_string(chain, ' > ') AS chain, levels::BIGINT AS levels FROM p WHERE kind = 'file'")
def format_chain(t: Tables):
    e = entries(t, orders=True)
    up = browse.ancestors(e, 4).join(e.select(F.col("id").alias("ancestor"), "name", "kind"), "ancestor")
    chain = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "name"))))
    out = up.groupBy("id").agg(F.array_join(F.transform(chain, lambda x: x["name"]), " > ").alias("chain"), F.count_if((F.col("kind") == "container") & (F.col("distance") > 0)).alias("levels"))
    return out.join(e.where("kind = 'file'"), "id", "left_semi")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^.*ring.*$', 'is') AND regexp_matches(p_name, '^s.*$', 'is')")
def find_glob(t: Tables):
    return t.part.where(browse.name_matches(F.col("p_name"), "*RING*") & browse.name_matches(F.col("p_name"), "S*")).select("p_partkey", "p_name")


@query(f"WITH {DEEP_SQL} SELECT id, name, type, depth FROM e WHERE kind = 'container' AND type = 'BUILDING' AND depth <= 2 AND regexp_matches(name, '^Customer#.*7$', 'is')")
def find_conjunction(t: Tables):
    return browse.find(entries(t, orders=True), "container", "customer#*7", "BUILDING", 2).select("id", "name", "type", "depth")


@query("WITH m AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n, count(*) OVER () AS k FROM part WHERE p_size > 40) SELECT p_partkey, k > 50 AS truncated FROM m WHERE n <= 50")
def find_limit(t: Tables):
    from quarry.operators.paging import limited

    return limited(t.part.where("p_size > 40"), ["p_partkey"], 50).select("p_partkey", "truncated")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def contains_text(t: Tables):
    return t.documents.where(F.contains("text", F.lit("License"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'sed u')")
def contains_bytes(t: Tables):
    return t.documents.where(browse.contains_bytes(F.col("text").cast("binary"), b"sed u")).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_discount > 0.08)")
def has_type_semi(t: Tables):
    return t.orders.join(t.lineitem.where("l_returnflag = 'R' and l_discount > 0.08"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query(f"WITH RECURSIVE {ENTRIES_SQL}, m AS (SELECT id FROM e WHERE name LIKE '%000012' OR name = 'NATION_3'), up AS (SELECT id FROM m UNION SELECT e.parent FROM e JOIN up USING (id) WHERE e.parent IS NOT NULL), down AS (SELECT id FROM m UNION SELECT e.id FROM e JOIN down ON e.parent = down.id) SELECT id, name FROM e WHERE id IN (SELECT id FROM up) OR id IN (SELECT id FROM down)")
def tree_filter(t: Tables):
    return browse.tree_filter(entries(t), F.col("name").endswith("000012") | (F.col("name") == "NATION_3"), 4).select("id", "name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans_anti(t: Tables):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' ELSE 'both' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def pairing_full_outer(t: Tables):
    return lookups.pairing(t.documents, t.labels, "doc_id")


@query("WITH k AS (SELECT p_type, p_brand, min(p_name) AS kind FROM part WHERE p_size > 25 GROUP BY ALL), a AS (SELECT p_type, min(p_name) AS kind FROM part GROUP BY ALL) SELECT p_partkey, coalesce(k.kind, a.kind) AS kind FROM part p LEFT JOIN k ON k.p_type = p.p_type AND k.p_brand = p.p_brand LEFT JOIN a ON a.p_type = p.p_type")
def fallback_lookup(t: Tables):
    exact = t.part.where("p_size > 25").groupBy("p_type", "p_brand").agg(F.min("p_name").alias("kind"))
    any_ = t.part.groupBy("p_type").agg(F.min("p_name").alias("kind")).withColumn("p_brand", F.lit(None).cast("string"))
    return lookups.fallback(t.part.select("p_partkey", "p_type", "p_brand"), exact.unionByName(any_), "p_type", "p_brand", "kind").select("p_partkey", "kind")


@query("WITH c AS (SELECT s_suppkey, c_custkey, 1 AS strategy FROM supplier JOIN customer ON c_nationkey = s_nationkey AND floor(c_acctbal / 500) = floor(s_acctbal / 500) UNION ALL SELECT s_suppkey, c_custkey, 2 FROM supplier JOIN customer ON c_nationkey = s_nationkey) SELECT s_suppkey, c_custkey, strategy FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY strategy, c_custkey) AS n FROM c) WHERE n = 1")
def resolve_priority(t: Tables):
    s, c = t.supplier, t.customer
    near = s.join(c, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.floor(F.col("c_acctbal") / 500) == F.floor(F.col("s_acctbal") / 500))).groupBy("s_suppkey").agg(F.min("c_custkey").alias("c_custkey"))
    firsts = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    same = s.join(firsts, F.col("c_nationkey") == F.col("s_nationkey")).select("s_suppkey", "c_custkey")
    return lookups.by_priority([near, same], "s_suppkey", ["c_custkey"]).select("s_suppkey", "c_custkey", "strategy")


@query("SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'unknown' WHEN p_type = 'ECONOMY' AND p_size < 10 THEN 'small economy' WHEN p_brand = 'Brand#2' THEN 'house brand' WHEN p_name LIKE '%ring' THEN 'ring' WHEN p_retailprice > 950 THEN 'dear' ELSE lower(p_type) END AS kind FROM part")
def kind_chain(t: Tables):
    c = F.col
    outcomes = [(c("p_size").isNull(), F.lit("unknown")), ((c("p_type") == "ECONOMY") & (c("p_size") < 10), F.lit("small economy")), (c("p_brand") == "Brand#2", F.lit("house brand")), (c("p_name").endswith("ring"), F.lit("ring")), (c("p_retailprice") > 950, F.lit("dear"))]
    return t.part.select("p_partkey", lookups.kind_of(outcomes, F.lower("p_type")).alias("kind"))


SUFFIXES = ["g", "ing", "ring", "et", "widget", "small ring", "t"]


@query("WITH s(suffix, ord) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(SUFFIXES)) + ") SELECT p_partkey, (SELECT arg_min(suffix, -len(suffix)) FROM s WHERE ends_with(p_name, suffix)) AS suffix FROM part")
def longest_suffix(t: Tables):
    return lookups.longest_suffix(t.part.select("p_partkey", "p_name"), "p_name", SUFFIXES).select("p_partkey", "suffix")


@query("WITH r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT event_id, coalesce((SELECT arg_max(value, ts) FROM r WHERE r.user_id = p.user_id AND r.ts <= p.ts), (SELECT arg_min(value, ts) FROM r WHERE r.user_id = p.user_id)) AS value FROM p")
def asof_run(t: Tables):
    runs = t.events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("start"), "value")
    points = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return lookups.as_of(points, runs, "user_id", "ts", "start", ["value"]).select("event_id", "value")


@query(f"WITH {EXTENTS_SQL} SELECT owner, start, p_partkey AS block FROM x JOIN part ON p_partkey >= start AND p_partkey < start + count")
def extent_range_join(t: Tables):
    return lookups.range_join(t.part.select(F.col("p_partkey").alias("block")), extents(t), "block", "start", "count", 64).select("owner", "start", "block")


@query("WITH a AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1), b AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' OR o_orderdate IS NULL GROUP BY 1) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.status IS DISTINCT FROM b.status OR a.priority IS DISTINCT FROM b.priority")
def snapshot_diff(t: Tables):
    """Two sides that are in the data: each customer's last order before 2000 and from 2000 on; every order is on one side."""
    last = [F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", "o_orderkey").alias("priority")]
    old = F.coalesce(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"), F.lit(False))
    a, b = (t.orders.where(side).groupBy("o_custkey").agg(*last) for side in (old, ~old))
    return lookups.snapshot_diff(a, b, "o_custkey", ["status", "priority"])


@query("""WITH RECURSIVE k AS (SELECT count(*) AS c FROM events), g AS (SELECT event_id AS s, (event_id * 7 + 3) % c AS d FROM events, k),
w AS (SELECT s AS source, [s] AS seen, FALSE AS looped, 0 AS n FROM g UNION ALL SELECT source, CASE WHEN d IS NULL OR list_contains(seen, d) THEN seen ELSE list_append(seen, d) END, looped OR coalesce(list_contains(seen, d), FALSE), n + 1 FROM w LEFT JOIN g ON g.s = seen[-1] WHERE n < 10)
SELECT source, seen[-1] AS last, (len(seen) - 1)::BIGINT AS hops, looped FROM w WHERE n = 10""")
def bounded_follow(t: Tables):
    """Follows every event: the targets are folded to the table's own count."""
    n = t.events.agg(F.count("*").alias("n"))
    edges = t.events.crossJoin(F.broadcast(n)).select("event_id", ((F.col("event_id") * 7 + 3) % F.col("n")).alias("to"))
    return lookups.follow(edges, "event_id", "to", 10)


@query("SELECT p_partkey, p_name FROM part WHERE (p_brand, p_partkey) > ('Brand#17', 100) ORDER BY p_brand, p_partkey LIMIT 200")
def page_cursor(t: Tables):
    return browse.page(t.part, ["p_brand", "p_partkey"], 200, ("Brand#17", 100)).select("p_partkey", "p_name")


@query(f"WITH {ENTRIES_SQL} SELECT a.id, b.id AS sibling FROM e a JOIN e b ON a.parent = b.parent AND a.id <> b.id WHERE a.kind = 'folder'")
def siblings(t: Tables):
    e = entries(t).where("kind = 'folder'")
    return e.alias("a").join(e.alias("b"), (F.col("a.parent") == F.col("b.parent")) & (F.col("a.id") != F.col("b.id"))).select("a.id", F.col("b.id").alias("sibling"))
