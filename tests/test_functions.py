"""Scalar functions, codecs, templates and containers; damaged bytes give diagnostics, never errors."""

import io
import random
import tracemalloc
import zipfile

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import codecs, scalars, templates
from quarry.registry import Tables
from quarry.sources import containers, resource_fork, writers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'binary' if isinstance(v, bytes) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())).select(column).first()[0]


def test_dates_and_numbers(spark):
    assert one(spark, scalars.mac_date(F.col("n")).cast("string"), n=4294967295) == "2040-02-06 06:28:15"
    assert one(spark, scalars.mac_date(F.col("n")), n=0) is None
    assert one(spark, scalars.to_fixed(F.col("x")), x=-1.5 / 65536) == -2
    assert one(spark, scalars.size_bytes(F.col("s")), s="10 MiB") == 10 << 20 and one(spark, scalars.size_bytes(F.col("s")), s="ten") is None
    assert one(spark, scalars.signed(F.col("b"), 1, 2), b=b"\x00\xff\xfe") == -2 and one(spark, scalars.unsigned(F.col("b"), 2, 2), b=b"abc") is None


def test_text(spark):
    assert one(spark, scalars.host_name(F.col("s")), s="a/b:c. ") == "a_b_c" and one(spark, scalars.host_name(F.col("s")), s="...") == "_"
    assert one(spark, scalars.newlines(F.col("s")), s="a\r\nb\rc") == "a\nb\nc"
    assert one(spark, scalars.escape_type(F.col("s")), s="a\\\x01b") == "a\\x5C\\x01b"
    assert one(spark, scalars.html_title(F.col("s")), s="<TITLE>a &amp;lt;\n b</title>") == "a &lt; b"
    for link, want in (("../x", "/a/x"), ("../../../x", None), ("http://h/", None), ("/q?z", "/q"), ("./y#z", "/a/b/y")):
        assert one(spark, scalars.resolve_url(F.lit("/a/b/c.html"), F.col("s")), s=link) == want


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600) | st.lists(st.sampled_from([b"\x90", b"aaaa", b"b", b"\x00" * 200]), max_size=20).map(b"".join))
def test_codecs_round_trip(data):
    for name, (to, back) in codecs.CODECS.items():
        assert back(to(data)) == data, name


def peak(f, *args):
    """What f returns, and the bytes that it held at most."""
    tracemalloc.start()
    out = f(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_codecs_hold_little_more_than_their_data(monkeypatch):
    data = random.Random(3).randbytes(400_000)
    text, held = peak(codecs.to_hqx, data)
    assert held < 12 * len(data)
    bits = "".join(f"{b:08b}" for b in codecs.rle90(data))
    plain = bytes(codecs.HQX[int(bits[i : i + 6].ljust(6, "0"), 2)] for i in range(0, len(bits), 6))
    assert b"".join(text.removeprefix(codecs.BANNER).split()) == b":" + plain + b":"
    back, held = peak(codecs.from_hqx, text)
    assert back == data and held < 12 * len(data)
    assert codecs.from_hqx(text[:-300] + b"~" + text[-299:]) is None
    assert [codecs.from_hqx(b":" + plain[:n] + b":") for n in range(5)] == [data[: n * 6 // 8] for n in range(5)]
    packed, held = peak(codecs.lzss, data)
    assert held < 60 * len(data)
    monkeypatch.setattr(codecs, "KEYS", 1 << 30)
    assert codecs.lzss(data) == packed
    text = b"".join(b"%d words and %d words, " % (i * i % 977, i) for i in range(9000))
    whole = codecs.lzss(text)
    monkeypatch.setattr(codecs, "KEYS", 5000)
    assert codecs.lzss(text) == whole and len(whole) < len(text) and codecs.unlzss(whole) == text


def test_round_trips_of_any_rows(spark):
    rows = [(1, bytearray(b"abc" * 50)), (2, bytearray()), (3, None), (None, bytearray(b"\x90" * 9))]
    out = codecs.roundtrips(spark.createDataFrame(rows, "i int, b binary"), "i", "b")
    assert out.columns == ["i", "n", *codecs.CODECS]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(i, len(b or b""), *[True] * 4) for i, b in rows], key=str)
    assert out.where("i > 9").count() == 0


def test_workers_get_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    keys = {k: spark.conf.get(k) for k in (key, "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set(key, "10000")
        Tables(spark, "")
        sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert sum(r[0] for r in sizes) == 5000 and max(r[0] for r in sizes) <= 1000
        spark.conf.set(key, "10")
        Tables(spark, "")
        assert spark.conf.get(key) == "10"
    finally:
        for k, v in keys.items():
            spark.conf.set(k, v)


def test_crc16():
    assert codecs.crc16([b"123456789", b""], 0x1021, False).tolist() == [0x31C3, 0]
    assert codecs.crc16([b"123456789", b"", b"1"], 0xA001, True).tolist()[:2] == [0xBB3D, 0]


def plain_crc16(data, polynomial, reflected):
    crc = 0
    for b in data:
        crc ^= b if reflected else b << 8
        for _ in range(8):
            crc = crc >> 1 ^ polynomial * (crc & 1) if reflected else (crc << 1 ^ polynomial * (crc >> 15)) & 0xFFFF
    return crc


def test_crc16_of_long_rows_holds_little_more_than_a_group(monkeypatch):
    r = random.Random(5)
    rows = [r.randbytes(n) for n in (0, 1, 127, 128, 129, 0, 255, 256, 257, 5000, 3)] + [bytes(300), b"\0" + b"a" * 128, b"\xff" * 128 + b"\0"]
    for group in (1, 1000, 1 << 20):
        monkeypatch.setattr(codecs, "GROUP", group, raising=False)
        for polynomial, reflected in ((0xA001, True), (0x8408, True), (0x8005, False), (0x1021, False)):
            assert codecs.crc16(rows, polynomial, reflected).tolist() == [plain_crc16(x, polynomial, reflected) for x in rows]
            assert codecs.crc16([], polynomial, reflected).tolist() == [] and codecs.crc16([b""], polynomial, reflected).tolist() == [0]
    many = [bytes([i % 251]) * 40_000 for i in range(400)]
    got, held = peak(codecs.crc16, many, 0xA001, True)
    assert held < sum(map(len, many)) // 2
    assert got[0] == 0 and got[1] == plain_crc16(many[1], 0xA001, True)


def test_crc16_column_of_any_rows(spark):
    rows = [(1, bytearray(b"123456789")), (2, bytearray()), (3, None), (None, bytearray(b"1" * 300))]
    d = spark.createDataFrame(rows, "i int, b binary").select("i", *(codecs.crc16_column(F.col("b"), p, r).alias(n) for p, r, n in ((0x1021, False, "x"), (0xA001, True, "a"))))
    want = [(i, *(None if b is None else plain_crc16(b, p, r) for p, r in ((0x1021, False), (0xA001, True)))) for i, b in rows]
    assert sorted((tuple(r) for r in d.collect()), key=str) == sorted(want, key=str)


def test_templates(spark):
    assert templates.check([("LSTC", "x"), ("LSTE", "")]) == ["list without a count"] and templates.check([("NOPE", "x")]) == ["unknown type NOPE"]
    t = [("OCNT", "n"), ("LSTC", "items"), ("PSTR", "s"), ("LSTE", ""), ("DWRD", "w")]
    d = spark.createDataFrame([(1, bytearray(b"\x00\x02\x01a\x02bc\xff\xff")), (2, bytearray(b"\x00\x01")), (3, None)], "i long, b binary")
    got = {r[0]: r[1:] for r in templates.parse(d, "i", "b", t).collect()}
    assert got[1] == ('{"n": 2, "items": [{"s": "a"}, {"s": "bc"}], "w": -1}', 0, 0) and got[2][1] == 2 and got[3][1] == 4


def test_containers():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/n.txt", b"hi")
    files = {"MacBinary II": writers.mac_binary("n", b"TEXT", b"ttxt", b"data", b"rsrc"), "AppleDouble": writers.apple_double(b"TEXT", b"ttxt", b"rsrc", "n"), "BinHex 4.0": writers.bin_hex("n", b"TEXT", b"ttxt", b"data" * 99, b"rsrc"), "Zip": z.getvalue()}
    for name, b in files.items():
        r = list(containers.probe(b))
        assert r[0]["format"] == name and r[0]["diagnostic"] is None, name
    rng = random.Random(7)
    for b in files.values():
        for _ in range(60):
            m = bytearray(b)
            for _ in range(4):
                m[rng.randrange(len(m))] = rng.randrange(256)
            list(containers.probe(bytes(m[: rng.randrange(len(m) + 1)])))


def test_resource_fork():
    rs = [("TEXT", 128, "a", 0, b"one"), ("PICT", -1, None, 4, b""), ("TEXT", 129, None, 0, b"two")]
    got = resource_fork.parse(resource_fork.build(rs))
    assert {(r["type"], r["number"], r.get("name"), r["attributes"], r["data"]) for r in got} == set(rs)
    rng, b = random.Random(3), resource_fork.build(rs)
    for _ in range(200):
        m = bytearray(b)
        m[rng.randrange(len(m))] = rng.randrange(256)
        resource_fork.parse(bytes(m[: rng.randrange(len(m) + 1)]))
