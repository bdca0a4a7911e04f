"""Queries of links, pairs, first-seen orders, subtree totals and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import browse, links
from quarry.plans.tables import ENTRIES_SQL, entries
from quarry.registry import Tables, query


@query("SELECT o_orderkey, c_custkey AS target FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def hard_link_targets(t: Tables):
    return links.hard_links(t.orders, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "target")


@query("SELECT c_custkey, c_nationkey::BIGINT AS stored, count(o_orderkey) AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING c_nationkey <> count(o_orderkey)")
def link_counts(t: Tables):
    return links.link_counts(t.orders, t.customer, "o_custkey", "c_custkey", "c_nationkey")


@query("SELECT c_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS names FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def aliases_reverse(t: Tables):
    out = links.aliases_to(t.customer, t.orders, "c_custkey", "o_custkey", F.col("o_orderkey"))
    return out.withColumn("names", F.array_join(F.transform("names", lambda x: x.cast("string")), ","))


_FILES = "SELECT p_brand AS folder, p_partkey::VARCHAR AS name FROM part WHERE p_size <> 7 UNION ALL SELECT p_brand, '._' || p_partkey FROM part WHERE p_size > 5"


@query(f"WITH f AS ({_FILES}), s AS (SELECT folder, CASE WHEN name LIKE '._%' AND left(name, 2) = '._' THEN substr(name, 3) ELSE name END AS name, left(name, 2) = '._' AS side FROM f) SELECT folder, name, max(NOT side) AS has_data, max(side) AS has_sidecar FROM s GROUP BY ALL")
def apple_double_pairs(t: Tables):
    key = F.col("p_partkey").cast("string")
    files = t.part.where("p_size <> 7").select(F.col("p_brand").alias("folder"), key.alias("name")).unionByName(t.part.where("p_size > 5").select(F.col("p_brand").alias("folder"), F.concat(F.lit("._"), key).alias("name")))
    return links.apple_double_pairs(files, "folder", "name")


@query("SELECT DISTINCT a.l_suppkey AS fork, a.l_partkey AS id, EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'A' AND b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey) AS has_right FROM lineitem a WHERE a.l_returnflag = 'R'")
def text_styles(t: Tables):
    return links.same_id(t.lineitem, "l_suppkey", "l_returnflag", "l_partkey", "R", "A")


@query("SELECT r.l_orderkey, r.l_linenumber, m.l_partkey FROM (SELECT l_orderkey, l_linenumber + 1 AS l_linenumber FROM lineitem) r LEFT JOIN lineitem m ON m.l_orderkey = r.l_orderkey AND m.l_linenumber = r.l_linenumber")
def bundle_local_ids(t: Tables):
    references = t.lineitem.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"))
    return links.local_ids(references, t.lineitem, ["l_orderkey"], "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%')")
def custom_icon_missing(t: Tables):
    return links.without_icon(t.customer.where("c_acctbal < 0").select("c_custkey"), t.orders, "c_custkey", "o_custkey", F.col("o_orderpriority").startswith("1-"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 + o_custkey % 3 FROM orders)")
def catalog_key_lookup(t: Tables):
    wanted = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_custkey") % 3).alias("l_linenumber"))
    return links.by_key(t.lineitem, wanted, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, before FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS before FROM lineitem) WHERE l_partkey < before")
def references_out_of_order(t: Tables):
    return links.out_of_order(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS first, b.l_partkey AS second FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def relocation_pairs(t: Tables):
    return links.adjacent(t.lineitem, "l_orderkey", "l_linenumber", 1, "l_partkey")


@query("WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY first, l_returnflag) AS kinds FROM f GROUP BY ALL")
def kinds_first_seen(t: Tables):
    return links.kinds_first_seen(t.lineitem, "l_orderkey", "l_returnflag", "l_linenumber").withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, count(*) AS resources FROM lineitem GROUP BY ALL")
def resource_counts(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("kinds"), F.count("*").alias("resources"))


@query("WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_returnflag) AS kind_rank FROM f) SELECT l_orderkey, l_linenumber, kind_rank::INT AS kind_rank, (row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_linenumber))::INT AS place FROM lineitem JOIN k USING (l_orderkey, l_returnflag)")
def list_resources(t: Tables):
    return links.listed(t.lineitem, "l_orderkey", "l_returnflag", "l_partkey", "l_linenumber").select("l_orderkey", "l_linenumber", "kind_rank", "place")


@query("SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY ALL")
def distinct_first_seen(t: Tables):
    return links.distinct_first_seen(t.lineitem, "l_partkey", "l_orderkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def row_set_difference(t: Tables):
    return t.customer.select("c_custkey").subtract(t.orders.select(F.col("o_custkey").alias("c_custkey")))


_UP = "u AS (SELECT id, id AS ancestor FROM e UNION ALL SELECT u.id, e.parent FROM u JOIN e ON e.id = u.ancestor WHERE e.parent IS NOT NULL)"


@query(f"WITH RECURSIVE {ENTRIES_SQL}, {_UP}, s AS (SELECT u.ancestor AS id, count(*) AS files, round(sum(size), 2) AS total FROM u JOIN e ON e.id = u.id WHERE e.kind = 'file' GROUP BY ALL) SELECT e.id, coalesce(files, 0) AS files, total FROM e LEFT JOIN s USING (id) WHERE kind = 'folder'")
def info_tree(t: Tables):
    e = entries(t)
    return links.subtree_totals(e, browse.ancestors(e, 4)).withColumn("total", F.round("total", 2))


@query(f"WITH RECURSIVE {ENTRIES_SQL}, o AS (SELECT id, parent, lpad((row_number() OVER (PARTITION BY parent ORDER BY name, id))::VARCHAR, 8, '0') AS place FROM e), k AS (SELECT id, place AS key FROM o WHERE parent IS NULL UNION ALL SELECT o.id, k.key || '/' || o.place FROM o JOIN k ON o.parent = k.id) SELECT * FROM k")
def depth_first(t: Tables):
    e = entries(t)
    return links.sibling_keys(e, browse.ancestors(e, 4))


@query("SELECT p_partkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE p_type END AS p_type, ((p_size | CASE WHEN s_suppkey IS NOT NULL THEN 8 ELSE 0 END) & ~(CASE WHEN s_suppkey IS NOT NULL THEN 2 ELSE 0 END)) AS p_size FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def edit_entries(t: Tables):
    changes = t.supplier.select(F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("p_type"), F.lit(8).alias("set_bits"), F.lit(2).alias("clear_bits"))
    return links.edit(t.part, changes, "p_partkey", ["p_type"], "p_size").select("p_partkey", "p_type", "p_size")


@query("SELECT 'error' AS severity, 'more than 100 entries; reading stopped' AS message FROM (SELECT count(*) AS n FROM customer) WHERE n > 100 UNION ALL SELECT 'entry', c_name FROM (SELECT c_name FROM customer ORDER BY c_custkey LIMIT 100)")
def entry_cap(t: Tables):
    first, note = links.capped(t.customer, ["c_custkey"], 100)
    return note.unionAll(first.select(F.lit("entry"), "c_name"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, count(*) AS files, sum(o_custkey)::BIGINT AS bytes FROM orders GROUP BY ROLLUP (o_orderstatus)")
def unpack_totals(t: Tables):
    return links.totals(t.orders, "o_orderstatus", "o_custkey")


@query("SELECT doc_id, left(text, 5) || '<new>' || substr(text, 9) AS text FROM documents WHERE text IS NOT NULL")
def splice_text(t: Tables):
    return t.documents.where("text is not null").select("doc_id", links.splice(F.col("text"), 5, 3, F.lit("<new>")).alias("text"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'en', ''))) / 2)::BIGINT AS n, CASE WHEN len(string_split(text, 'en')) > 2 THEN length(string_split(text, 'en')[1]) + length(string_split(text, 'en')[2]) + 2 END::BIGINT AS second FROM documents WHERE text IS NOT NULL")
def find_occurrences(t: Tables):
    return t.documents.where("text is not null").select("doc_id", links.occurrences(F.col("text"), "en").alias("n"), links.occurrence(F.col("text"), "en", 2).alias("second"))


@query(f"WITH RECURSIVE {ENTRIES_SQL}, p AS (SELECT id, upper(name) AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, p.path || ':' || upper(e.name) FROM e JOIN p ON e.parent = p.id), w AS (SELECT o_orderkey, r_name || ':' || n_name || ':customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS path FROM orders, region, nation WHERE n_nationkey = o_custkey % 25 AND n_regionkey = r_regionkey) SELECT o_orderkey, p.id FROM w LEFT JOIN p ON p.path = upper(w.path)")
def path_resolve(t: Tables):
    e = entries(t)
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(":", "r_name", "n_name").alias("folder"))
    wanted = t.orders.withColumn("n_nationkey", F.col("o_custkey") % 25).join(names, "n_nationkey")
    wanted = wanted.select("o_orderkey", F.concat("folder", F.lit(":customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("path"))
    return links.resolve_paths(wanted, browse.paths(e, 4).select("id", "path")).select("o_orderkey", "id")


@query("SELECT a.doc_id, translate(left(a.text, 40), 'abcdefghijklmnopqrstuvwxyzäåàãæçéñöõøœü' || chr(160), 'ABCDEFGHIJKLMNOPQRSTUVWXYZÄÅÀÃÆÇÉÑÖÕØŒÜ ') AS folded FROM documents a WHERE text IS NOT NULL")
def hfs_names(t: Tables):
    return t.documents.where("text is not null").select("doc_id", links.hfs_fold(F.substring("text", 1, 40)).alias("folded"))


@query("SELECT o_orderkey, strftime(try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', 1980 + ((d >> 9) & 127), (d >> 5) & 15, d & 31, (c >> 11) & 31, (c >> 5) & 63, (c & 31) * 2), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS time FROM (SELECT o_orderkey, (o_orderkey * 37 % 65536)::INT AS d, (o_custkey * 11 % 49152)::INT AS c FROM orders) WHERE (c & 31) < 30 AND ((c >> 5) & 63) < 60")
def dos_times(t: Tables):
    o = t.orders.select("o_orderkey", (F.col("o_orderkey") * 37 % 65536).cast("int").alias("d"), (F.col("o_custkey") * 11 % 49152).cast("int").alias("c"))
    o = o.where("(c & 31) < 30 and (shiftright(c, 5) & 63) < 60")
    return o.select("o_orderkey", F.date_format(links.dos_time(F.col("d"), F.col("c")), "yyyy-MM-dd'T'HH:mm:ss").alias("time"))


@query("SELECT p_partkey, printf('#%02X%02X%02X', r * 8 + (r >> 2), g * 8 + (g >> 2), b * 8 + (b >> 2)) AS colour FROM (SELECT p_partkey, ((p_partkey * 77) >> 10)::INT & 31 AS r, ((p_partkey * 77) >> 5)::INT & 31 AS g, (p_partkey * 77)::INT & 31 AS b FROM part)")
def colours(t: Tables):
    return t.part.select("p_partkey", links.rgb555((F.col("p_partkey") * 77).cast("int")).alias("colour"))


@query("SELECT p_partkey, hex(encode(p_name)) AS bytes, (row_number() OVER (PARTITION BY p_brand ORDER BY hex(encode(p_name)), p_partkey))::INT AS place FROM part")
def ordinal_sort(t: Tables):
    from pyspark.sql import Window

    return t.part.select("p_partkey", F.hex(F.encode("p_name", "UTF-8")).alias("bytes"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.encode("p_name", "UTF-8"), "p_partkey")).alias("place"))


@query("SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"kind\":\"' || c_mktsegment || '\",\"folder\":' || c_nationkey || '}' AS json FROM customer")
def result_json(t: Tables):
    return t.customer.select("c_custkey", links.result_json(t.customer, {"name": F.col("c_name"), "kind": F.col("c_mktsegment"), "folder": F.col("c_nationkey")}).alias("json"))
