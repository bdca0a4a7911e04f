"""A small HFS volume, built here: its files, its tables and what the checks find in damaged ones."""

import random
import struct

import pytest

from quarry.operators import volume_checks
from quarry.sources import containers, hfs, volumes

BLOCK = 512


def node(kind, records, forward=0, height=1):
    body, offsets = b"", []
    for r in records:
        offsets.append(14 + len(body))
        body += r + bytes(len(r) % 2)
    offsets.append(14 + len(body))
    tail = struct.pack(f">{len(offsets)}H", *offsets[::-1])
    return struct.pack(">IIBBHH", forward, 0, kind, height, len(records), 0) + body + bytes(512 - 14 - len(body) - len(tail)) + tail


def tree(leaves):
    first = 1 if leaves else 0
    head = struct.pack(">HIIIIHHII", 1, first, sum(map(len, leaves)), first, len(leaves), 512, 37, 8, 0).ljust(106, b"\0")
    return node(1, [head, bytes(128), b"\x80" + bytes(255)]) + b"".join(node(0xFF, leaf, i + 2 if i + 1 < len(leaves) else 0) for i, leaf in enumerate(leaves))


def key(parent, name):
    raw = b"\0" + struct.pack(">IB", parent, len(name)) + name.encode()
    return bytes([len(raw)]) + raw + bytes((1 + len(raw)) % 2)


def image(valence=1, root_valence=2, free=None, last_start=None):
    """Root 2 with file 'a' and folder 16 'sub' that holds 'b' (two forks)."""
    folder = lambda id_, n: b"\1\0" + struct.pack(">HHIIII", 0, n, id_, 9, 9, 0) + bytes(48)
    thread = lambda parent, name: b"\3\0" + bytes(8) + struct.pack(">IB", parent, len(name)) + name.encode().ljust(31, b"\0")

    def file(id_, data, rsrc):
        return b"\2\0\0\0" + b"TEXTttxt" + bytes(8) + struct.pack(">IHIIHII", id_, 0, data[2], 512, 0, rsrc[2], 512) + struct.pack(">III", 9, 9, 0) + bytes(18) + struct.pack(">6H", data[0], data[1], 0, 0, 0, 0) + struct.pack(">6H", rsrc[0], rsrc[1], 0, 0, 0, 0) + bytes(4)

    a, b, r = b"hello", b"x" * 700, b"rsrc"
    start = 20 if last_start is None else last_start
    leaves = [
        [key(1, "Vol") + folder(2, root_valence), key(2, "") + thread(1, "Vol"), key(2, "a") + file(17, (20, 1, len(a)), (0, 0, 0))],
        [key(2, "sub") + folder(16, valence), key(16, "") + thread(2, "sub"), key(16, "b") + file(18, (start + 1, 2, len(b)), (23, 1, len(r)))],
    ]
    catalog, extents = tree(leaves), tree([])
    blocks = bytearray(BLOCK * 40)
    blocks[0 : len(extents)] = extents
    blocks[5 * BLOCK : 5 * BLOCK + len(catalog)] = catalog
    blocks[20 * BLOCK : 20 * BLOCK + len(a)] = a
    blocks[21 * BLOCK : 21 * BLOCK + len(b)] = b
    blocks[23 * BLOCK : 23 * BLOCK + len(r)] = r
    used = (1 << 39) | sum(1 << (39 - i) for i in (5, 6, 7, 20, 21, 22, 23))
    mdb = bytearray(512)
    mdb[0:2] = b"BD"
    struct.pack_into(">HHHHIIHIH", mdb, 12, 1, 3, 0, 40, BLOCK, 0, 5, 19, 32 if free is None else free)
    mdb[36:40] = b"\3Vol"
    struct.pack_into(">II", mdb, 84, 2, 1)
    struct.pack_into(">I6H", mdb, 130, len(extents), 0, 1, 0, 0, 0, 0)
    struct.pack_into(">I6H", mdb, 146, len(catalog), 5, 3, 0, 0, 0, 0)
    return bytes(1024) + bytes(mdb) + used.to_bytes(5, "big").ljust(512, b"\0") + bytes(512) + bytes(blocks)


def test_files_and_mutations():
    rows = list(containers.probe(image(), volumes.ALL))
    assert [(r["name"], r["folder"], r["data"], r["resource"], r["type"], r["diagnostic"]) for r in rows] == [("a", ["Vol"], b"hello", b"", "TEXT", None), ("b", ["Vol", "sub"], b"x" * 700, b"rsrc", "TEXT", None)]
    rng = random.Random(4)
    for _ in range(300):
        m = bytearray(image())
        for _ in range(5):
            m[rng.randrange(1024, len(m))] = rng.randrange(256)
        list(containers.probe(bytes(m[: rng.randrange(1024, len(m) + 1)]), volumes.ALL))


@pytest.mark.parametrize(
    "options,codes",
    [({}, set()), ({"valence": 4}, {"wrong number of items in folder"}), ({"free": 30}, {"wrong free blocks"}), ({"last_start": 19}, {"overlapping extents"}), ({"last_start": 38}, {"extent past the end"})],
)
def test_checks(spark, options, codes):
    files = spark.createDataFrame([("v", bytearray(image(**options))), ("no volume", bytearray(b"text"))], "path string, content binary")
    found = volume_checks.check(*hfs.tables(files), depth=8).collect()
    assert {f.code for f in found} == codes and all(f.volume == "v" for f in found)
