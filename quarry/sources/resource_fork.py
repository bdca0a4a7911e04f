"""Resource forks: bytes to rows of resources and back."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "id bigint, ordinal int, type string, number int, name string, attributes int, data binary, diagnostic string"


def parse(b: bytes) -> list[dict]:
    """Resources in order of the map; damaged parts become diagnostics."""
    out: list[dict] = []
    if len(b) < 16:
        return [{"diagnostic": "too short for a header"}] if b else []
    data_at, map_at, _, map_n = struct.unpack_from(">IIII", b)
    if map_at + 30 > len(b) or map_at + map_n > len(b):
        return [{"diagnostic": "map lies past the end"}]
    types_at, names_at = (map_at + x for x in struct.unpack_from(">HH", b, map_at + 24))
    count = struct.unpack_from(">H", b, types_at)[0] + 1 & 0xFFFF if types_at + 2 <= len(b) else 0
    for i in range(count):
        at = types_at + 2 + 8 * i
        if at + 8 > len(b):
            out.append({"diagnostic": "type list is cut off"})
            break
        code, n, refs = b[at : at + 4].decode("mac_roman"), *struct.unpack_from(">HH", b, at + 4)
        for j in range(n + 1):
            r = types_at + refs + 12 * j
            if r + 12 > len(b):
                out.append({"type": code, "diagnostic": "reference list is cut off"})
                break
            number, name_at, place = struct.unpack_from(">hHI", b, r)
            attributes, place = place >> 24, data_at + (place & 0xFFFFFF)
            row = {"ordinal": len(out), "type": code, "number": number, "attributes": attributes}
            if name_at != 0xFFFF and names_at + name_at < len(b):
                s = names_at + name_at
                row["name"] = b[s + 1 : s + 1 + b[s]].decode("mac_roman")
            if place + 4 > len(b):
                row["diagnostic"] = "data lie past the end"
            else:
                size = struct.unpack_from(">I", b, place)[0]
                row["data"] = b[place + 4 : place + 4 + size]
                if len(row["data"]) < size:
                    row["diagnostic"] = "data are cut off"
            out.append(row)
    return out


def build(resources: list[tuple[str, int, str | None, int, bytes]]) -> bytes:
    """A fork of (type, number, name, attributes, data), types in order of first appearance."""
    types: dict[str, list] = {}
    for r in resources:
        types.setdefault(r[0], []).append(r)
    data, names, lists = b"", b"", b""
    heads, at = b"", 2 + 8 * len(types)
    for code, rows in types.items():
        heads += code.encode("mac_roman")[:4].ljust(4) + struct.pack(">HH", len(rows) - 1, at + len(lists))
        for _, number, name, attributes, body in rows:
            where = 0xFFFF if name is None else len(names)
            if name is not None:
                raw = name.encode("mac_roman", "replace")[:255]
                names += bytes([len(raw)]) + raw
            lists += struct.pack(">hHII", number, where, attributes << 24 | len(data), 0)
            data += struct.pack(">I", len(body)) + body
    table = struct.pack(">H", (len(types) - 1) & 0xFFFF) + heads + lists
    map_ = bytes(24) + struct.pack(">HH", 28, 28 + len(table)) + table + names
    return struct.pack(">IIII", 256, 256 + len(data), len(data), len(map_)).ljust(256, b"\0") + data + map_


def read(forks: DataFrame, id_col: str, data: str) -> DataFrame:
    """(id, ordinal, type, number, name, attributes, data, diagnostic) for each resource of each fork."""

    def run(batches):
        kinds = {"id": pa.int64(), "ordinal": pa.int32(), "type": pa.string(), "number": pa.int32(), "name": pa.string(), "attributes": pa.int32(), "data": pa.binary(), "diagnostic": pa.string()}
        for batch in batches:
            rows = [{"id": i, **r} for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in parse(b or b"")]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in kinds} for r in rows], schema=pa.schema(list(kinds.items())))

    return forks.select(forks[id_col].cast("long"), data).mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
