"""Paths, source texts, kinds, compressed images and streams."""

import bz2
import plistlib
import struct
import zlib

import pytest

from quarry.functions import paths, rez
from quarry.sources import containers, kinds, udif, volumes
from quarry.streaming import changes


def test_paths():
    assert paths.split("Disk:A/B:x") == ["Disk", "A/B", "x"] and paths.split("a//b/") == ["a", "b"] and paths.split(r"a\:b/c") == ["a:b", "c"]
    assert paths.split("f:'a:b':3") == ["f", "'a:b'", "3"] and paths.split("") == []
    for names in (["a"], ["a:b", "c/d"], ["x\\y", "z"]):
        assert paths.split(paths.join(names)) == names


def test_rez():
    rs = [("TEXT", 128, 'a "b"', 4, bytes(range(40))), ("'x\\ ", -3, None, 0, b"")]
    assert rez.compile_text(rez.write(rs)) == rs
    assert rez.compile_text("data 'STR ' (1, purgeable) { $\"02\" \"hi\" }; // end") == [("STR ", 1, None, 32, b"\x02hi")]
    for bad in ("data 'STR ' (1) { $\"0\" ;", "resource", "data 'A' (x) {};", "@"):
        with pytest.raises((rez.RezError, ValueError)):
            rez.compile_text(bad)


def test_kinds(spark, tmp_path):
    (tmp_path / "k.tsv").write_text("# note\n\ntype\tcreator\tkind\n#BIN\t\tBinary\nTEXT\tttxt\tNote\n\tx\ty\n")
    assert sorted(tuple(r) for r in kinds.read(spark, str(tmp_path / "k.tsv")).collect()) == [("#BIN", None, "Binary", 0), ("TEXT", "ttxt", "Note", 1)]


def test_udif():
    assert udif.adc(b"\x82abc\x00\x02\x40\x00\x00", 10) == b"abcabccccc"
    a, c = b"A" * 1024, bytes(range(256)) * 4
    chunks, body, table = [(0x80000005, a, zlib.compress(a)), (0x80000006, c, bz2.compress(c)), (2, bytes(512), b""), (1, c, c)], b"", b""
    first = 0
    for kind, plain, packed in chunks:
        table += struct.pack(">IIQQQQ", kind, 0, first, len(plain) // 512, len(body), len(packed))
        body += packed
        first += len(plain) // 512
    mish = b"mish" + struct.pack(">IQQQ", 1, 0, first, 0).ljust(196, b"\0") + struct.pack(">I", len(chunks)) + table
    xml = plistlib.dumps({"resource-fork": {"blkx": [{"Name": "disk", "Data": mish}]}})
    trailer = bytearray(512)
    trailer[:4] = b"koly"
    struct.pack_into(">QQ", trailer, 0xD8, len(body), len(xml))
    image = body + xml + bytes(trailer)
    rows = list(containers.probe(image, volumes.ALL))
    assert rows[0]["data"] == b"".join(p for _, p, _ in chunks) and rows[0]["diagnostic"] is None
    assert list(containers.probe(image[:50] + b"??" + image[52:], volumes.ALL))[0]["diagnostic"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1, "a"), ("x", 3, "b"), ("y", 2, "c")], "k string, v long, val string")
    rows.write.parquet(str(tmp_path / "in"))
    q = changes.latest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "v", ["val"]).writeStream.format("memory").queryName("latest_changes").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("latest_changes").collect()) == [("x", "b"), ("y", "c")]
