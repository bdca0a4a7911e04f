"""Writers of the containers that the readers read."""

from __future__ import annotations

import binascii
import struct

from quarry.functions.codecs import to_hqx


def mac_binary(name: str, type_: bytes, creator: bytes, data: bytes, resource: bytes, created: int = 0, modified: int = 0) -> bytes:
    """MacBinary II."""
    raw = name.encode("mac_roman", "replace")[:63]
    head = bytearray(128)
    head[1 : 2 + len(raw)] = bytes([len(raw)]) + raw
    head[65:73] = type_[:4].ljust(4) + creator[:4].ljust(4)
    struct.pack_into(">IIII", head, 83, len(data), len(resource), created, modified)
    head[122], head[123] = 129, 129
    struct.pack_into(">H", head, 124, binascii.crc_hqx(bytes(head[:124]), 0))
    pad = lambda b: b + bytes(-len(b) % 128)
    return bytes(head) + pad(data) + pad(resource)


def apple_double(type_: bytes, creator: bytes, resource: bytes, name: str = "") -> bytes:
    parts = [(3, name.encode("mac_roman", "replace")), (9, type_[:4].ljust(4) + creator[:4].ljust(4) + bytes(24)), (2, resource)]
    at, table, body = 26 + 12 * len(parts), b"", b""
    for id_, b in parts:
        table += struct.pack(">III", id_, at + len(body), len(b))
        body += b
    return struct.pack(">II16xH", 0x00051607, 0x00020000, len(parts)) + table + body


def bin_hex(name: str, type_: bytes, creator: bytes, data: bytes, resource: bytes) -> bytes:
    raw = name.encode("mac_roman", "replace")[:63]
    crc = lambda b: struct.pack(">H", binascii.crc_hqx(b, 0))
    head = bytes([len(raw)]) + raw + b"\0" + type_[:4].ljust(4) + creator[:4].ljust(4) + struct.pack(">HII", 0, len(data), len(resource))
    return to_hqx(head + crc(head) + data + crc(data) + resource + crc(resource))
