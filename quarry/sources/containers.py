"""Readers of container files: bytes in, rows of files out, the first format that recognises the bytes wins.

Rows: path, format, name, folder (array), type, creator, data, resource, created, modified, and diagnostics of what could not be read. A reader never
fails on damaged bytes: it yields what it could read and says so.
"""

from __future__ import annotations

import binascii
import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.functions.codecs import from_hqx

SCHEMA = "path string, format string, name string, folder array<string>, type string, creator string, data binary, resource binary, created bigint, modified bigint, diagnostic string"
Row = dict


def _row(format_: str, name: str = "", folder: list[str] | None = None, type_: bytes = b"", creator: bytes = b"", data: bytes | None = None, resource: bytes | None = None, created: int | None = None, modified: int | None = None, diagnostic: str | None = None) -> Row:
    text = lambda b: b.decode("mac_roman") if b.strip(b"\0") else None
    return {"format": format_, "name": name, "folder": folder or [], "type": text(type_), "creator": text(creator), "data": data, "resource": resource, "created": created, "modified": modified, "diagnostic": diagnostic}


def _u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big")


def _u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def apple_single(b: bytes) -> Iterator[Row] | None:
    """Header 00051600 (all in one) or 00051607 (without the data fork): a table of (id, offset, length)."""
    kind = {0x00051600: "AppleSingle", 0x00051607: "AppleDouble"}.get(_u32(b, 0)) if len(b) >= 26 else None
    if not kind:
        return None
    parts, notes = {}, []
    for i in range(_u16(b, 24)):
        at = 26 + 12 * i
        if at + 12 > len(b):
            notes.append("entry table is cut off")
            break
        id_, offset, n = struct.unpack_from(">III", b, at)
        if offset + n > len(b):
            notes.append(f"entry {id_} reaches past the end")
        parts.setdefault(id_, b[offset : offset + n])
    info, dates = parts.get(9, b""), parts.get(8, b"")
    day = lambda at: int.from_bytes(dates[at : at + 4], "big", signed=True) + 3029529600 if len(dates) >= at + 4 else None
    return iter([_row(kind, parts.get(3, b"").decode("mac_roman"), None, info[:4], info[4:8], parts.get(1), parts.get(2), day(0), day(4), "; ".join(notes) or None)])


def mac_binary(b: bytes) -> Iterator[Row] | None:
    """A 128-byte header with lengths; version III has its mark, II and III a CRC, I neither."""
    if len(b) < 128 or b[0] or b[74] or not 1 <= b[1] <= 63:
        return None
    data, resource, extra = _u32(b, 83), _u32(b, 87), _u16(b, 120)
    crc = binascii.crc_hqx(b[:124], 0) == _u16(b, 124)
    version = "III" if b[102:106] == b"mBIN" else "II" if crc else "I"
    if version == "I" and (b[82] or any(b[101:126]) or data + resource > 0x7FFFFF * 2):
        return None
    up = lambda n: n + -n % 128
    at = 128 + up(extra)
    end = at + up(data)
    note = None if end + resource <= len(b) else "forks reach past the end"
    return iter([_row(f"MacBinary {version}", b[2 : 2 + b[1]].decode("mac_roman"), None, b[65:69], b[69:73], b[at : at + data], b[end : end + resource], _u32(b, 91) or None, _u32(b, 95) or None, note)])


def bin_hex(b: bytes) -> Iterator[Row] | None:
    """Text with its banner, which mail headers of up to 64 KiB may precede: name, type, creator, flags and both forks, each with a CRC."""
    banner = b[: 1 << 16].find(b"(This file must be converted with BinHex")
    if banner < 0 and b"BinHex" not in b[:4096] or banner >= 4096 and b"\0" in b[:banner]:
        return None
    raw = from_hqx(b[max(banner, 0) :])
    if raw is None or len(raw) < 22 or len(raw) < 22 + raw[0]:
        return iter([_row("BinHex 4.0", diagnostic="text can't be decoded")])
    n = raw[0]
    head = n + 20
    data, resource = _u32(raw, n + 12), _u32(raw, n + 16)
    at = head + 2
    crc = lambda part, where: binascii.crc_hqx(part + b"\0\0", 0) == _u16(raw, where)
    d, r = raw[at : at + data], raw[at + data + 2 : at + data + 2 + resource]
    bad = [what for what, ok in (("header", binascii.crc_hqx(raw[:head], 0) == _u16(raw, head) or crc(raw[:head], head)), ("data fork", binascii.crc_hqx(d, 0) == _u16(raw, at + data) or crc(d, at + data)), ("resource fork", binascii.crc_hqx(r, 0) == _u16(raw, at + data + 2 + resource) or crc(r, at + data + 2 + resource))) if not ok]
    return iter([_row("BinHex 4.0", raw[1 : 1 + n].decode("mac_roman"), None, raw[n + 2 : n + 6], raw[n + 6 : n + 10], d, r, diagnostic="; ".join(f"CRC of the {x} is wrong" for x in bad) or None)])


def gzip_file(b: bytes) -> Iterator[Row] | None:
    if b[:3] != b"\x1f\x8b\x08":
        return None
    name = b""
    if len(b) > 10 and b[3] & 8 and not b[3] & 4:
        name = b[10:].split(b"\0")[0]
    try:
        return iter([_row("gzip", name.decode("latin-1"), data=gzip.decompress(b), modified=int.from_bytes(b[4:8], "little") + 2082844800 if any(b[4:8]) else None)])
    except (OSError, EOFError, zlib.error) as e:
        return iter([_row("gzip", name.decode("latin-1"), diagnostic=str(e))])


def zip_file(b: bytes) -> Iterator[Row] | None:
    if b[:4] not in (b"PK\x03\x04", b"PK\x05\x06"):
        return None

    def rows():
        try:
            with zipfile.ZipFile(io.BytesIO(b)) as z:
                for i in z.infolist():
                    *folder, name = i.filename.rstrip("/").split("/")
                    if not i.is_dir():
                        try:
                            yield _row("Zip", name, folder, data=z.read(i))
                        except Exception as e:
                            yield _row("Zip", name, folder, diagnostic=str(e))
        except zipfile.BadZipFile as e:
            yield _row("Zip", diagnostic=str(e))

    return rows()


def tar_file(b: bytes) -> Iterator[Row] | None:
    if b[257:262] != b"ustar":
        return None

    def rows():
        try:
            with tarfile.open(fileobj=io.BytesIO(b)) as t:
                for m in t:
                    if m.isfile():
                        *folder, name = m.name.split("/")
                        yield _row("tar", name, folder, data=t.extractfile(m).read(), modified=int(m.mtime) + 2082844800)
        except tarfile.TarError as e:
            yield _row("tar", diagnostic=str(e))

    return rows()


def partition_map(b: bytes) -> Iterator[Row] | None:
    """'PM' entries of 512 bytes from block 1: one row for each partition."""
    if b[512:514] != b"PM":
        return None

    def rows():
        total = _u32(b, 516)
        for i in range(1, total + 1):
            e = b[512 * i : 512 * i + 512]
            if e[:2] != b"PM":
                yield _row("Apple partition map", diagnostic=f"entry {i} of {total} is missing")
                return
            start, n = _u32(e, 8), _u32(e, 12)
            text = lambda x: x.split(b"\0")[0].decode("mac_roman")
            yield _row("Apple partition map", text(e[16:48]), [text(e[48:80])], data=b[512 * start : 512 * (start + n)], diagnostic=None if 512 * (start + n) <= len(b) else "partition reaches past the end")

    return rows()


def disk_copy(b: bytes) -> Iterator[Row] | None:
    """DiskCopy 4.2: a name, sizes and rotating checksums before the sectors."""
    if len(b) < 84 or b[82:84] != b"\x01\x00" or not b[0] <= 63:
        return None
    n = _u32(b, 64)
    data, total = b[84 : 84 + n], 0
    for i in range(0, len(data) - 1, 2):
        total = total + _u16(data, i) & 0xFFFFFFFF
        total = total >> 1 | (total & 1) << 31
    note = "sectors are cut off" if len(data) < n else None if total == _u32(b, 72) else "checksum is wrong"
    return iter([_row("DiskCopy 4.2", b[1 : 1 + b[0]].decode("mac_roman"), data=data, diagnostic=note)])


def dos_partitions(b: bytes) -> Iterator[Row] | None:
    """Four entries of 16 bytes before 55AA."""
    if len(b) < 512 or b[510:512] != b"\x55\xaa" or not any(b[446:510]) or any(b[446 + 16 * i] not in (0, 0x80) for i in range(4)):
        return None

    def rows():
        for i in range(4):
            e = b[446 + 16 * i : 462 + 16 * i]
            start, n = int.from_bytes(e[8:12], "little"), int.from_bytes(e[12:16], "little")
            if e[4]:
                yield _row("DOS partition table", f"partition {i + 1}", [f"{e[4]:02X}"], data=b[512 * start : 512 * (start + n)], diagnostic=None if 512 * (start + n) <= len(b) else "partition reaches past the end")

    return rows()


#: In order of probing: an earlier one wins.
READERS: list[Callable[[bytes], Iterator[Row] | None]] = [apple_single, mac_binary, bin_hex, zip_file, gzip_file, tar_file, partition_map, disk_copy, dos_partitions]


def probe(data: bytes, readers: list | None = None) -> Iterator[Row]:
    """Rows of the first reader that takes the bytes; none where none does."""
    for reader in readers or READERS:
        rows = reader(data)
        if rows is not None:
            return rows
    return iter(())


def every_reader() -> list[Callable[[bytes], Iterator[Row] | None]]:
    """All built-in readers in order of probing, volumes and archives included."""
    from quarry.sources.volumes import ALL

    return ALL


def nested(data: bytes, readers: list, depth: int) -> Iterator[Row]:
    """The rows of a container, and of containers in their data, down to depth levels; a file inside has the container's folder and name as its folder."""
    for r in probe(data, readers):
        yield r
        if depth > 1 and r["data"] and len(r["data"]) < len(data) << 10:
            for inner in nested(r["data"], readers, depth - 1):
                yield {**inner, "format": f"{r['format']} > {inner['format']}", "folder": [*r["folder"], r["name"], *inner["folder"]]}


def expand(files: DataFrame, path: str = "path", content: str = "content", own: list | None = None, depth: int = 1) -> DataFrame:
    """One row for each file inside the given files, and inside what these hold, down to depth levels; own: readers that come before the built-in ones."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    schema = pa.schema([(n, {"folder": pa.list_(pa.string()), "data": pa.binary(), "resource": pa.binary(), "created": pa.int64(), "modified": pa.int64()}.get(n, pa.string())) for n in names])

    def run(batches):
        readers = [*(own or []), *every_reader()]
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r in nested(c or b"", readers, depth):
                    yield pa.RecordBatch.from_pylist([{"path": p, **r}], schema=schema)

    return files.select(path, content).mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str, depth: int = 8) -> DataFrame:
    """The containers below a path, expanded down to depth levels."""
    return expand(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), depth=depth)
