"""Volumes, texts that carry files, resource decoders."""

import base64
import binascii
import random
import struct

from quarry.sources import containers, decoders, resource_fork, volumes


def iso(files):
    block = 2048
    body, records = b"", b""

    def record(name, extent, size, flags=0):
        r = bytes([33 + len(name) + (1 - len(name) % 2), 0]) + struct.pack("<I", extent) + struct.pack(">I", extent) + struct.pack("<I", size) + struct.pack(">I", size) + bytes(7) + bytes([flags]) + bytes(6) + bytes([len(name)]) + name
        return r + bytes(r[0] - len(r))

    at = 20
    for name, data in files.items():
        records += record(name.encode() + b";1", at, len(data))
        body += data + bytes(-len(data) % block)
        at += -(-len(data) // block)
    root = record(b"\0", 19, block, 2)
    pvd = bytearray(block)
    pvd[0:6], pvd[128:130], pvd[156 : 156 + len(root)] = b"\x01CD001", struct.pack("<H", block), root
    return bytes(16 * block) + bytes(pvd) + bytes(2 * block) + records.ljust(block, b"\0") + body


def fat12(files):
    sector = 512
    boot = bytearray(sector)
    boot[0], boot[510:512] = 0xEB, b"\x55\xaa"
    struct.pack_into("<HBHBHHBH", boot, 11, sector, 1, 1, 2, 16, 100, 0xF8, 1)
    table, root, body, c = [0xFF8, 0xFFF], b"", b"", 2
    for name, data in files.items():
        stem, ext = name.split(".")
        n = max(1, -(-len(data) // sector))
        root += stem.ljust(8).encode() + ext.ljust(3).encode() + bytes(15) + struct.pack("<HI", c, len(data))
        table += [*range(c + 1, c + n), 0xFFF]
        body += data + bytes(n * sector - len(data))
        c += n
    packed = bytearray(sector)
    for i, v in enumerate(table):
        at = i * 12 // 8
        old = int.from_bytes(packed[at : at + 2], "little")
        packed[at : at + 2] = (old | (v << 4 if i & 1 else v)).to_bytes(2, "little")
    return bytes(boot) + bytes(packed) * 2 + root.ljust(sector, b"\0") + body


def test_volumes():
    files = {"A.TXT": b"one" * 900, "B.TXT": b"two"}
    for image, name in ((iso(files), "ISO 9660"), (fat12(files), "FAT12")):
        rows = list(containers.probe(image, volumes.ALL))
        assert {r["format"] for r in rows} == {name} and {r["name"]: r["data"] for r in rows} == files and not any(r["diagnostic"] for r in rows)
        rng = random.Random(1)
        for _ in range(150):
            m = bytearray(image)
            for _ in range(3):
                m[rng.randrange(len(m))] = rng.randrange(256)
            list(containers.probe(bytes(m[: rng.randrange(len(m) + 1)]), volumes.ALL))


def test_texts():
    data = bytes(range(256)) * 2
    lines = b"".join(binascii.b2a_uu(data[i : i + 45]) for i in range(0, len(data), 45))
    b = b"hello\nbegin 644 a.bin\n" + lines + b"`\nend\nbegin-base64 644 b.bin\n" + base64.b64encode(data) + b"\n====\n"
    assert [(r["name"], r["data"], r["diagnostic"]) for r in containers.probe(b, volumes.ALL)] == [("a.bin", data, None), ("b.bin", data, None)]
    cue = b'FILE "x.bin" BINARY\n TRACK 01 MODE1/2352\n  INDEX 01 00:00:00\n TRACK 02 AUDIO\n  INDEX 00 01:00:00\n  INDEX 01 01:02:10\n'
    assert [(r["name"], r["data"]) for r in containers.probe(cue, volumes.ALL)] == [("Track 01", b"0"), ("Track 02", b"4660")]


def test_decoders(spark):
    rs = [("STR ", 1, None, 0, b"\x02hi"), ("STR#", 1, None, 0, b"\x00\x02\x01a\x01b"), ("vers", 1, None, 0, b"\x07\x53\x80\x00\x00\x00\x037.5\x047.5x"), ("TEXT", 1, None, 0, b"a\rb"), ("STR ", 2, None, 0, b"\x09hi"), ("XXXX", 1, None, 0, b"?"), ("SIZE", -1, None, 0, struct.pack(">HII", 1, 2, 3))]
    fork = spark.createDataFrame([(1, bytearray(resource_fork.build(rs))), (2, None)], "id long, fork binary")
    got = {(r["type"], r["number"]): (r["extension"], r["content"], r["warning"]) for r in decoders.decode(resource_fork.read(fork, "id", "fork")).collect()}
    assert got["STR ", 1] == ("txt", "hi", None) and got["STR#", 1][1] == '["a", "b"]' and got["TEXT", 1][1] == "a\nb"
    assert got["STR ", 2] == ("bin", None, "string is cut off") and got["XXXX", 1] == ("bin", None, None)
    assert '"major": 7' in got["vers", 1][1] and '"minimum": 3' in got["SIZE", -1][1]
    rng = random.Random(2)
    for code in decoders.DECODERS:
        for _ in range(100):
            decoders.decode_one(code, bytes(rng.randrange(256) for _ in range(rng.randrange(40))))
