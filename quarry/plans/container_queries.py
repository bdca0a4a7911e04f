"""Queries that pack the tables into containers and read them back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quarry.registry import Tables, query
from quarry.sources import containers, resource_fork, writers


@query("SELECT doc_id, 'MacBinary II' AS format, 'doc' || doc_id AS name, 'TEXT' AS type, strlen(text)::BIGINT AS n, sha256(text) AS digest FROM documents")
def mac_binary_roundtrip(t: Tables):
    pack = F.pandas_udf(lambda i, s: pd.Series([writers.mac_binary(f"doc{k}", b"TEXT", b"qrry", x.encode(), b"") for k, x in zip(i, s, strict=True)]), "binary")
    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), pack("doc_id", "text").alias("content"))
    return containers.expand(files).select(F.col("path").cast("long").alias("doc_id"), "format", "name", "type", F.octet_length("data").cast("long").alias("n"), F.sha2("data", 256).alias("digest"))


@query("SELECT page_id, 'BinHex 4.0' AS format, sha256(html) AS digest FROM pages")
def bin_hex_roundtrip(t: Tables):
    pack = F.pandas_udf(lambda s: pd.Series([writers.bin_hex("page", b"HTML", b"qrry", x.encode(), b"") for x in s]), "binary")
    files = t.pages.select(F.col("page_id").cast("string").alias("path"), pack("html").alias("content"))
    return containers.expand(files).where("diagnostic is null").select(F.col("path").cast("long").alias("page_id"), "format", F.sha2("data", 256).alias("digest"))


@query("SELECT conv_id, turn, role, sha256(text) AS digest FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)")
def resource_fork_roundtrip(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "role", "text").distinct()
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rs"))
    pack = F.pandas_udf(lambda s: pd.Series([resource_fork.build([("TEXT", r["turn"], r["role"], 0, r["text"].encode()) for r in rs]) for rs in s]), "binary")
    read = resource_fork.read(packed.select("conv_id", pack("rs").alias("fork")), "conv_id", "fork")
    return read.select("conv_id", F.col("number").cast("long").alias("turn"), F.col("name").alias("role"), F.sha2("data", 256).alias("digest"))
