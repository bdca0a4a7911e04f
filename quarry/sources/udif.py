"""Compressed disk images with a trailer at their end (UDIF): chunks of sectors by table, decoded into the disk's bytes."""

from __future__ import annotations

import bz2
import lzma
import plistlib
import struct
import zlib
from collections.abc import Iterator

from quarry.sources.containers import Row, _row

#: Bytes of one image at most.
LARGEST = 1 << 30


def adc(data: bytes, size: int) -> bytes:
    """Apple Data Compression: literals, and copies with short or long distance. A token that passes the end of the output, a copy from before its
    start and input that ends before the output is full are errors."""
    out, i = bytearray(), 0
    while len(out) < size:
        need = 1 if i >= len(data) else (data[i] & 0x7F) + 2 if data[i] & 0x80 else 3 if data[i] & 0x40 else 2
        if i + need > len(data):
            raise ValueError("the input ends too early")
        c = data[i]
        n = need - 1 if c & 0x80 else (c & 0x3F) + 4 if c & 0x40 else (c >> 2) + 3
        if len(out) + n > size:
            raise ValueError("a token passes the end of the output")
        if c & 0x80:
            out += data[i + 1 : i + need]
        else:
            back = 1 + (int.from_bytes(data[i + 1 : i + 3], "big") if c & 0x40 else (c & 3) << 8 | data[i + 1])
            if back > len(out):
                raise ValueError("copy from before the start")
            for _ in range(n):
                out.append(out[-back])
        i += need
    return bytes(out)


DECODE = {1: lambda b, n: b, 0x80000004: adc, 0x80000005: lambda b, n: zlib.decompress(b), 0x80000006: lambda b, n: bz2.decompress(b), 0x80000008: lambda b, n: lzma.decompress(b)}


def udif(b: bytes) -> Iterator[Row] | None:
    """One row for each block table: a partition or the whole disk."""
    if len(b) < 512 or b[-512:-508] != b"koly":
        return None

    def rows():
        at, n = struct.unpack_from(">QQ", b, len(b) - 512 + 0xD8)
        try:
            tables = plistlib.loads(b[at : at + n])["resource-fork"]["blkx"]
        except Exception as e:
            yield _row("UDIF", diagnostic=f"property list can't be read: {e}")
            return
        for t in tables:
            raw, out, note = bytes(t.get("Data", b"")), {}, None
            if raw[:4] != b"mish" or len(raw) < 204:
                yield _row("UDIF", str(t.get("Name", "")), diagnostic="block table is damaged")
                continue
            sectors, base = struct.unpack_from(">QQ", raw, 16)
            total = 0
            for i in range(min(struct.unpack_from(">I", raw, 200)[0], (len(raw) - 204) // 40)):
                kind, _, first, count, offset, length = struct.unpack_from(">IIQQQQ", raw, 204 + 40 * i)
                total += count * 512
                if total > LARGEST:
                    note = "image is too large"
                    break
                if kind in (0, 2):
                    out[first] = bytes(count * 512)
                elif kind in DECODE:
                    try:
                        out[first] = DECODE[kind](b[base + offset : base + offset + length], count * 512)
                    except Exception as e:
                        note = f"chunk {i} can't be decoded: {e}"
                        out[first] = bytes(count * 512)
                elif kind not in (0x7FFFFFFE, 0xFFFFFFFF):
                    note = f"chunk {i} is of an unknown kind"
            disk, covered = bytearray(min(sectors * 512, LARGEST)), 0
            for first, chunk in sorted(out.items()):  # each at its own sector; holes stay zero
                disk[first * 512 : first * 512 + len(chunk)] = chunk[: max(0, len(disk) - first * 512)]
                covered += len(chunk)
            yield _row("UDIF", str(t.get("Name", "")), data=bytes(disk), diagnostic=note or (None if covered == sectors * 512 else "chunks do not cover the disk"))

    return rows()
