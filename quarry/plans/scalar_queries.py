"""Queries of scalar functions, text, URLs and HTML, binary fields and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import codecs, scalars, templates
from quarry.registry import Tables, query


@query("SELECT event_id, TIMESTAMP '1904-01-01' + to_seconds(nullif((event_id * 104729 + 2082844800) % 4294967296 * (event_id % 97 <> 0)::BIGINT, 0)) AS at FROM events")
def mac_date(t: Tables):
    s = (F.col("event_id") * 104729 + 2082844800) % 4294967296 * F.when(F.col("event_id") % 97 != 0, 1).otherwise(0)
    return t.events.select("event_id", scalars.mac_date(s).alias("at"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (sign(l_discount - 0.05) * floor(abs(l_discount - 0.05) * 65536 + 0.5))::BIGINT AS raw FROM lineitem")
def fixed_point(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.to_fixed(F.col("l_discount") - F.lit(0.05)).alias("raw"))


@query("SELECT p_partkey, (p_size::BIGINT * CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END)::BIGINT AS bytes FROM part")
def size_text(t: Tables):
    unit = F.element_at(F.array(F.lit(""), F.lit(" KiB"), F.lit("MB"), F.lit(" g")), F.col("p_size") % 4 + 1)
    return t.part.select("p_partkey", scalars.size_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_text(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query()
def crc32_text(t: Tables):
    return t.documents.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query()
def crc16_text(t: Tables):
    return t.documents.select("doc_id", codecs.crc16_column(F.col("text").cast("binary"), 0x1021, False).alias("xmodem"), codecs.crc16_column(F.col("text").cast("binary"), 0xA001, True).alias("arc"))


@query()
def hex_dump(t: Tables):
    """Every document's whole dump."""
    return t.documents.select("doc_id", scalars.hex_lines(F.col("text").cast("binary")).alias("dump"))


@query("SELECT doc_id, md5(replace(replace(replace(text, chr(10), chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents")
def newline_norm(t: Tables):
    return t.documents.select("doc_id", F.md5(scalars.newlines(F.replace("text", F.lit("\n"), F.lit("\r")))).alias("digest"))


@query(r"""SELECT doc_id, CASE WHEN n = '' THEN '_' ELSE n END AS name FROM (SELECT doc_id, rtrim(regexp_replace(regexp_replace(substr(text, 1, 60), '[\x00-\x1F<>:"/\\|?*]', '_', 'g'), '[. ]+$', '')) AS n FROM documents)""")
def host_name(t: Tables):
    return t.documents.select("doc_id", scalars.host_name(F.col("text")).alias("name"))


@query(r"""SELECT page_id, nullif(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title', 1, 'is'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '') AS title FROM pages""")
def html_title(t: Tables):
    return t.pages.select("page_id", scalars.html_title(F.col("html")).alias("title"))


@query(r"""SELECT page_id, nullif(lower(regexp_extract(substr(html, 1, 1024), '<meta[^>]*charset\s*=\s*["'']?([A-Za-z0-9_-]+)', 1, 'i')), '') AS charset FROM pages""")
def html_charset(t: Tables):
    return t.pages.select("page_id", scalars.html_charset(F.col("html")).alias("charset"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<meta\s+name\s*=\s*["'']viewport["'']\s+content\s*=\s*["'']([^"'']*)["'']', 1, 'is'), '') AS viewport FROM pages""")
def html_meta(t: Tables):
    return t.pages.select("page_id", scalars.html_meta(F.col("html"), "viewport").alias("viewport"))


@query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<script\b[^>]*>).*?</script\s*>', '\1', 'gis'), '(<style\b[^>]*>).*?</style\s*>', '\1', 'gis'), '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x)), ' ') AS tags FROM pages""")
def html_tags(t: Tables):
    return t.pages.select("page_id", F.array_join(scalars.html_tags(F.col("html")), " ").alias("tags"))


@query()
def url_resolve(t: Tables):
    path = F.parse_url("url", F.lit("PATH"))
    links = F.explode(F.array(F.lit("../a.html"), F.lit("b/./c.html#x"), F.lit("/d?q=1"), F.lit("../../../../e"), F.lit("http://other/")))
    return t.pages.select("page_id", path.alias("path"), links.alias("link")).select("page_id", "link", scalars.resolve_url(F.col("path"), F.col("link")).alias("target"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query()
def template_fields(t: Tables):
    """Fields of every document, whatever its first bytes are; fields that the text is too short for are null."""
    return templates.fixed_fields(t.documents.select("doc_id", F.col("text").cast("binary").alias("data")), "data", [("word", "DWRD"), ("byte", "DBYT"), ("code", "TNAM")])


@query()
def template_lists(t: Tables):
    d = t.documents.select("doc_id", F.col("text").cast("binary").alias("data"))
    return templates.parse(d, "doc_id", "data", [("DWRD", "first"), ("LSTB", "items"), ("PSTR", "name"), ("LSTE", "items")])


@query("SELECT doc_id, strlen(text)::BIGINT AS n, TRUE AS packbits, TRUE AS rle90, TRUE AS lzss, TRUE AS binhex FROM documents")
def codec_roundtrip(t: Tables):
    return codecs.roundtrips(t.documents.select("doc_id", F.col("text").cast("binary").alias("data")), "doc_id", "data")
