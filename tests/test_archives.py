"""Archives, older volumes and sample codecs from bytes put together by hand, damaged ones, and containers inside containers."""

import gzip
import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import codecs
from quarry.operators import browse, links
from quarry.sources import archives, containers, volumes


def bits(*parts):
    s = "".join(f"{v:0{n}b}" for v, n in parts)
    return int(s.ljust(-(-len(s) // 8) * 8, "0"), 2).to_bytes(-(-len(s) // 8), "big")


ONE = bits((5, 16), (0, 5), (0, 5), (0, 9), (65, 9), (0, 4), (0, 4))
#: A and a match of three at distance 1, each of one bit.
TWO = bits((2, 16), (4, 5), (0, 3), (0, 3), (1, 3), (0, 2), (1, 3), (257, 9), (0, 1), (45, 9), (1, 1), (0, 1), (170, 9), (1, 1), (0, 4), (0, 4), (0, 1), (1, 1))


def test_lh5():
    assert archives.unlh(ONE, 5, 13) == b"AAAAA" and archives.unlh(TWO, 4, 13) == b"AAAA"
    with pytest.raises(ValueError):
        archives.unlh(TWO[:2], 4, 13)


def lha_file(name, method, raw, data):
    head = method + struct.pack("<IIIBB", len(raw), len(data), 0, 32, 0) + bytes([len(name)]) + name + struct.pack("<H", archives.crc16(data))
    return bytes([len(head), sum(head) & 255]) + head + raw


def test_lha():
    assert archives.crc16(b"123456789") == 0xBB3D  # the check value of CRC-16/ARC
    b = lha_file(b"dir/a.txt", b"-lh0-", b"hello", b"hello") + lha_file(b"b", b"-lh5-", TWO, b"AAAA") + lha_file(b"c", b"-lh9-", b"?", b"x") + lha_file(b"d", b"-lh0-", b"bad", b"bat") + b"\0"
    rows = list(containers.probe(b, volumes.ALL))
    assert [(r["name"], r["folder"], r["data"], r["diagnostic"]) for r in rows[:2]] == [("a.txt", ["dir"], b"hello", None), ("b", [], b"AAAA", None)]
    assert "not known" in rows[2]["diagnostic"] and rows[3]["diagnostic"] == "checksum is wrong"
    for cut in range(22, len(b)):
        list(containers.probe(b[:cut], volumes.ALL))


def stuffit_entry(name, method, raw, data, rm=0):
    return struct.pack(">BBB63s4s4sHIIIIIIHH6xH", rm, method, len(name), name, b"TEXT", b"ttxt", 0, 1, 2, 0, len(data), 0, len(raw), 0, archives.crc16(data), 0) + raw


def test_stuffit():
    tree = bits((0, 1), (1, 1), (97, 8), (1, 1), (98, 8), (0, 1), (1, 1), (1, 1), (0, 1))
    b = b"SIT!" + struct.pack(">HI4sBB6x", 4, 0, b"rLau", 1, 0)
    b += stuffit_entry(b"folder", 32, b"", b"") + stuffit_entry(b"a", 0, b"plain", b"plain") + stuffit_entry(b"b", 1, b"x\x90\x05", b"xxxxx") + stuffit_entry(b"", 33, b"", b"")
    b += stuffit_entry(b"c", 3, tree, b"abba") + stuffit_entry(b"d", 13, b"?", b"x") + stuffit_entry(b"e", 0x80, b"?", b"x")
    rows = list(containers.probe(b, volumes.ALL))
    assert [(r["name"], r["folder"], r["data"], r["diagnostic"]) for r in rows[:3]] == [("a", ["folder"], b"plain", None), ("b", ["folder"], b"xxxxx", None), ("c", [], b"abba", None)]
    assert "method 13" in rows[3]["diagnostic"] and "encrypted" in rows[4]["diagnostic"] and rows[0]["type"] == "TEXT"
    for cut in range(22, len(b), 7):
        list(containers.probe(b[:cut], volumes.ALL))


def mfs_image():
    b = bytearray(512 * 20)
    struct.pack_into(">H", b, 1024, 0xD2D7)
    struct.pack_into(">HHHHI", b, 1024 + 12, 1, 4, 2, 8, 512)
    struct.pack_into(">H", b, 1024 + 28, 8)
    entry = bytearray(51 + 5)
    entry[0], entry[2:10], entry[50], entry[51:] = 0x80, b"TEXTttxt", 5, b"Notes"
    struct.pack_into(">HII", entry, 22, 2, 700, 1024)
    struct.pack_into(">HI", entry, 32, 5, 3)
    b[2048 : 2048 + 56] = entry
    codes = {2: 4, 4: 1, 5: 1}  # block 2 goes on in 4
    for k in range(2, 10):
        at, v = 1088 + (k - 2) * 3 // 2, codes.get(k, 0)
        if k & 1:
            b[at], b[at + 1] = b[at] | v >> 8, v & 255
        else:
            b[at], b[at + 1] = v >> 4, b[at + 1] | (v & 15) << 4
    b[4096 : 4096 + 512], b[4096 + 1024 : 4096 + 1024 + 188], b[4096 + 1536 : 4096 + 1539] = b"1" * 512, b"2" * 188, b"res"
    return bytes(b)


def test_mfs():
    (row,) = containers.probe(mfs_image(), volumes.ALL)
    assert (row["name"], row["type"], row["creator"], row["data"], row["resource"], row["diagnostic"]) == ("Notes", "TEXT", "ttxt", b"1" * 512 + b"2" * 188, b"res", None)
    broken = bytearray(mfs_image())
    broken[1089] &= 0x0F  # the chain runs into a free block
    assert len(list(containers.probe(bytes(broken), volumes.ALL))[0]["data"]) == 512


def test_raw_cd():
    sector = lambda mode, body: archives.SYNC + b"\0\2\0" + bytes([mode]) + (b"" if mode == 1 else b"\0" * 8) + body.ljust(2048, b".") + b"\0" * (288 if mode == 1 else 280)
    (row,) = containers.probe(sector(1, b"one") + sector(2, b"two"), volumes.ALL)
    assert row["data"] == b"one".ljust(2048, b".") + b"two".ljust(2048, b".") and row["diagnostic"] is None


def test_nested(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("x/a.lzh", lha_file(b"deep", b"-lh5-", TWO, b"AAAA") + b"\0")
    files = spark.createDataFrame([("f", gzip.compress(inner.getvalue())), ("n", None)], "path string, content binary")
    rows = {r.format: r for r in containers.expand(files, depth=5).collect()}
    assert len(rows) == 3 and [f for f in rows if f.endswith("LHA")] and rows[max(rows, key=len)].data == b"AAAA" and rows[max(rows, key=len)].folder[-1].endswith("a.lzh")
    assert containers.expand(files).count() == 1


def test_lzss_by_its_description():
    assert codecs.unlzss(b"\x07abc\xee\xf0") == b"abcabc"  # a match at the place where writing began
    assert codecs.unlzss(b"\x00\x00\x0f") == b" " * 18  # the ring begins full of spaces
    assert codecs.unlzss(b"\x01a\x00") == b"a"  # a cut-off match is dropped
    rng = random.Random(1)
    data = bytes(rng.choices(b"abcd ", k=20000))
    assert codecs.unlzss(codecs.lzss(data)) == data and len(codecs.lzss(data)) < len(data)
    with pytest.raises(ValueError):
        codecs.unlzss(codecs.lzss(data), 100)


def test_samples():
    assert codecs.ima4(b"\0\0" + b"\0" * 32) == [[0] * 64]
    (got,) = codecs.ima4(b"\x01\x00" + b"\x07" + b"\0" * 31)  # predictor 256; a step of 7 + 3 + 1 = 11, then number 8: 16 >> 3
    assert got[:2] == [267, 269]
    assert [len(c) for c in codecs.ima4(bytes(68), 2)] == [64, 64]
    assert codecs.pcm(b"\x00\x80\xff", 8, signed=False) == [-128, 0, 127] and codecs.pcm(b"\xff\xfe\x01", 16, signed=True) == [-2]
    steps = codecs._ima_steps()
    assert len(steps) == 89 and steps == sorted(steps)


def test_deep_chain_walk(spark):
    n = 90
    e = spark.createDataFrame([(f"{i}", f"{i - 1}" if i else None, "container" if i % 3 == 0 else "folder", f"N{i}") for i in range(n)], "id string, parent string, kind string, name string")
    up = browse.ancestors(e)
    assert up.count() == n * (n + 1) // 2
    depth = {r.id: r.depth for r in browse.container_depth(e).collect()}
    assert depth == {str(i): sum(k % 3 == 0 for k in range(i)) for i in range(n)}
    assert browse.tree_filter(e, F.col("id") == "40").count() == n
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    assert browse.ancestors(loop, 8).count() > 0


def test_catalog_names(spark):
    d = spark.createDataFrame([("Café",), ("CAFÉ",), ("cafe",), ("CAFÈ",)], "n string")
    assert [r[0] for r in d.where(browse.name_matches(F.col("n"), "café")).collect()] == ["Café", "CAFÉ"]
    assert {r[0] for r in d.select(links.hfs_fold(F.col("n"))).collect()} == {"CAFÉ", "CAFE", "CAFÈ"}
