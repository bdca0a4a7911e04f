"""Queries that take every row of their tables, against plain versions of them on the smallest tables."""

from quarry.plans import all as _all  # noqa: F401
from quarry.registry import QUERIES, Tables

SF = "/root/testdata/sf0.001"


def got(spark, name, *cols):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*cols).collect())


def test_bounded_follow_takes_every_event(spark):
    ids = [r[0] for r in Tables(spark, SF).events.select("event_id").collect()]
    to, want = {i: (i * 7 + 3) % len(ids) for i in ids}, []
    for i in ids:
        seen, looped = [i], False
        for _ in range(10):
            nxt = to.get(seen[-1])
            looped = looped or nxt in seen
            if not looped and nxt is not None:
                seen.append(nxt)
        want.append((i, seen[-1], len(seen) - 1, looped))
    assert len(ids) > 500 and got(spark, "bounded_follow", "source", "last", "hops", "looped") == sorted(want)


def test_joins_and_gaps_take_every_row(spark):
    t = Tables(spark, SF)
    lines = t.lineitem.groupBy("l_orderkey", "l_partkey").agg({"l_quantity": "sum"}).collect()
    used, parts = {}, {r[0] for r in t.part.select("p_partkey").collect()}
    for owner, start, n in lines:
        used.setdefault(owner, set()).update(range(start, start + int(n)))
    assert got(spark, "bitmap_usage_by_owner", "owner", "used") == sorted((o, len(b)) for o, b in used.items() if b)
    assert got(spark, "extent_range_join", "owner", "start", "block") == sorted((o, s, b) for o, s, n in lines for b in range(s, s + int(n)) if b in parts)
    assert got(spark, "next_free_id", "next_id") == [(min(set(range(128, 32768)) - set(used)),)]
    sides = {}, {}
    for c, k, day, *v in sorted(tuple(r) for r in t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority").collect()):
        sides[day.year >= 2000][c] = v
    a, b = sides
    change = {c: "added" if c not in a else "removed" if c not in b else "changed" for c in {*a, *b} if a.get(c) != b.get(c)}
    assert change and got(spark, "snapshot_diff", "o_custkey", "change") == sorted(change.items())


def test_blocks_used_counts_overlaps_once(spark):
    from quarry.operators import checks

    x = spark.createDataFrame([(2, 0, 10), (2, 3, 2), (2, 8, 4), (2, 20, 1), (3, 5, 0), (4, 7, 3), (4, 7, 3)], "o int, s long, n long")
    assert sorted(tuple(r) for r in checks.blocks_used(x, "o", "s", "n").collect()) == [(2, 13), (4, 3)]


def plain_dump(b):
    out = []
    for at in range(0, len(b), 16):
        line = b[at : at + 16]
        pairs = [f"{x:02X} " for x in line] + ["   "] * (16 - len(line))
        shown = "".join("." if x < 0x20 or x == 0x7F else bytes([x]).decode("mac_roman") for x in line)
        out.append(f"{at:08X}  {''.join(pairs[:8])} {''.join(pairs[8:])} {shown}\n")
    return "".join(out)


def plain_fields(b):
    word = int.from_bytes(b[:2], "big", signed=True) if len(b) >= 2 else None
    return word, int.from_bytes(b[2:3], "big", signed=True) if len(b) >= 3 else None, b[3:7].decode("mac_roman") if len(b) >= 7 else None


def test_dump_and_fields_take_every_document(spark):
    docs = {i: x.encode() for i, x in Tables(spark, SF).documents.select("doc_id", "text").collect()}
    assert any(max(b[:8]) > 0x7F for b in docs.values())
    assert got(spark, "hex_dump", "doc_id", "dump") == sorted((i, plain_dump(b)) for i, b in docs.items())
    assert got(spark, "template_fields", "doc_id", "word", "byte", "code") == sorted((i, *plain_fields(b)) for i, b in docs.items())


def test_dump_and_fields_of_any_bytes(spark):
    from pyspark.sql import functions as F

    from quarry.functions import scalars, templates

    rows = [bytes(range(256)), b"", b"\x00", b"a" * 16, b"b" * 17, b"\xff\xfe\x80\xe9", b"xy", None]
    d = spark.createDataFrame([(i, b and bytearray(b) if b is not None else None) for i, b in enumerate(rows)], "i int, data binary")
    assert {r.i: r.dump for r in d.select("i", scalars.hex_lines(F.col("data")).alias("dump")).collect()} == {i: None if b is None else plain_dump(b) for i, b in enumerate(rows)}
    fields = templates.fixed_fields(d.where("data is not null"), "data", [("word", "DWRD"), ("byte", "DBYT"), ("code", "TNAM")])
    assert {r.i: (r.word, r.byte, r.code) for r in fields.collect()} == {i: plain_fields(b) for i, b in enumerate(rows) if b is not None}


def test_unique_names_counts_on_until_free(spark):
    from quarry.operators import ordered

    names = ["x", "x", "X ~2", "x", "x ~2", "a.b.txt", "A.B ~2.TXT", "a.b.txt", ".x", ".X", "", "", None, None]
    d = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    taken, want = set(), {}
    for i, x in enumerate(names):
        y, k = x, 2
        dot = x.rfind(".") if x else -1
        while x is not None and y.lower() in taken:
            y, k = f"{x[:dot]} ~{k}{x[dot:]}" if dot > 0 else f"{x} ~{k}", k + 1
        want[i] = y
        taken |= {y.lower()} if x is not None else set()
    assert want[2] == "X ~2 ~2" and {r.i: r.unique_name for r in ordered.unique_names(d, "n", ["i"]).collect()} == want


def test_bin_hex_after_long_mail_headers():
    from quarry.sources import containers, writers

    hqx = writers.bin_hex("n", b"TEXT", b"ttxt", b"data" * 99, b"rsrc")
    for head in (b"Received: by BinHex relay: a\n", b"Received: from x\n" * 1000, b"Subject: BinHex: of n\n" + b"Received: from x\n" * 3000):
        r = list(containers.probe(head + hqx))
        assert [(x["format"], x["data"], x["resource"], x["diagnostic"]) for x in r] == [("BinHex 4.0", b"data" * 99, b"rsrc", None)], len(head)
    assert list(containers.probe(b"Received: from x\n" * 4000 + hqx)) == []
