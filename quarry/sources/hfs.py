"""HFS volumes: the catalog and extents B-trees as tables, files as rows.

`tables` gives what the integrity checks read: one row for each volume, catalog record and extent. `hfs` is the reader of files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.sources.containers import Row, _row

NODES = 1 << 20


class Volume:
    """The parts of a volume; notes hold what could not be read."""

    def __init__(self, b: bytes):
        self.b, self.notes = b, []
        (self.files_in_root, self.map_at, _, self.blocks, self.block, _, self.first, self.next_id, self.free) = struct.unpack_from(">HHHHIIHIH", b, 1036)
        n = min(b[1060], 27)
        self.name = b[1061 : 1061 + n].decode("mac_roman")
        self.created, self.modified = struct.unpack_from(">II", b, 1026)
        self.file_count, self.folder_count = struct.unpack_from(">II", b, 1024 + 84)
        self.overflow: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for key, data in self._leaves(self._fork(*struct.unpack_from(">I", b, 1024 + 130), b[1024 + 134 : 1024 + 146], 3), "extents"):
            if len(key) >= 8 and len(data) >= 12:
                fork, id_, start = struct.unpack_from(">BIH", key, 1)
                self.overflow.setdefault((fork, id_), []).append((start, *struct.unpack_from(">HHHHHH", data)))
        self.catalog = list(self._leaves(self._fork(*struct.unpack_from(">I", b, 1024 + 146), b[1024 + 150 : 1024 + 162], 4), "catalog"))

    def extents(self, record: bytes, id_: int = 0, fork: int = 0) -> list[tuple[int, int]]:
        """(start, count) in order: the record's three, then those of the overflow tree."""
        more = [v for _, *v in sorted(self.overflow.get((fork, id_), []))]
        flat = [*struct.unpack(">6H", record.ljust(12, b"\0")), *(x for v in more for x in v)]
        return [(s, n) for s, n in zip(flat[::2], flat[1::2], strict=True) if n]

    def _fork(self, size: int, record: bytes, id_: int, fork: int = 0) -> bytes:
        out = b"".join(self.b[self.first * 512 + s * self.block :][: n * self.block] for s, n in self.extents(record, id_, fork))
        return out[:size]

    def _leaves(self, tree: bytes, what: str) -> Iterator[tuple[bytes, bytes]]:
        """Keys and data of the leaf chain; every node once."""
        if len(tree) < 512:
            self.notes.append(f"{what} tree is missing")
            return
        first, size = struct.unpack_from(">I", tree, 24)[0], struct.unpack_from(">H", tree, 32)[0]
        if size < 512 or size & (size - 1):
            self.notes.append(f"{what} tree has a bad node size")
            return
        seen: set[int] = set()
        while first and len(seen) < NODES:
            node = tree[first * size : (first + 1) * size]
            if first in seen or len(node) < size or node[8] != 0xFF:
                self.notes.append(f"{what} tree: node {first} is no leaf, lies past the end or comes twice")
                return
            seen.add(first)
            n = struct.unpack_from(">H", node, 10)[0]
            if 14 + 2 * (n + 1) > size:
                self.notes.append(f"{what} tree: node {first} has too many records")
                return
            ends = struct.unpack_from(f">{n + 1}H", node, size - 2 * (n + 1))[::-1]
            for a, e in zip(ends[:-1], ends[1:], strict=True):
                if not 14 <= a < e <= size - 2 * (n + 1):
                    self.notes.append(f"{what} tree: node {first} has a record out of bounds")
                    continue
                k = node[a]
                yield node[a + 1 : a + 1 + k], node[a + 1 + k + (1 + k) % 2 : e]
            first = struct.unpack_from(">I", node)[0]

    def records(self) -> Iterator[dict]:
        """Catalog records with their place in key order."""
        for i, (key, data) in enumerate(self.catalog):
            if len(key) < 6 or not data:
                self.notes.append(f"catalog record {i} has a bad key")
                continue
            parent, n = struct.unpack_from(">xIB", key)
            r = {"ordinal": i, "parent": parent, "name": key[6 : 6 + n].decode("mac_roman")}
            try:
                if data[0] == 1:
                    valence, id_, created, modified = struct.unpack_from(">HIII", data, 4)
                    yield r | {"kind": "folder", "id": id_, "valence": valence, "created": created, "modified": modified}
                elif data[0] == 2:
                    yield r | {"kind": "file", "id": struct.unpack_from(">I", data, 20)[0], "type": data[4:8].decode("mac_roman"), "creator": data[8:12].decode("mac_roman"), "data_size": struct.unpack_from(">I", data, 26)[0], "resource_size": struct.unpack_from(">I", data, 36)[0], "created": struct.unpack_from(">I", data, 44)[0], "modified": struct.unpack_from(">I", data, 48)[0], "_data": data[74:86], "_resource": data[86:98]}
                elif data[0] in (3, 4):
                    at, m = struct.unpack_from(">IB", data, 10)
                    yield r | {"kind": "folder thread" if data[0] == 3 else "file thread", "id": parent, "parent": at, "name": data[15 : 15 + m].decode("mac_roman")}
                else:
                    self.notes.append(f"catalog record {i} has an unknown type")
            except struct.error:
                self.notes.append(f"catalog record {i} is cut off")

    def used_blocks(self) -> int:
        """Blocks that the volume's bitmap marks."""
        bits = self.b[self.map_at * 512 :][: (self.blocks + 7) // 8]
        return (int.from_bytes(bits, "big") >> (len(bits) * 8 - min(self.blocks, len(bits) * 8))).bit_count()


def _open(b: bytes) -> Volume | None:
    if len(b) < 1536 or b[1024:1026] != b"BD":
        return None
    return Volume(b)


def hfs(b: bytes) -> Iterator[Row] | None:
    v = _open(b)
    if v is None:
        return None

    def rows():
        records = list(v.records())
        up = {r["id"]: (r["parent"], r["name"]) for r in records if r["kind"] == "folder"}
        for r in records:
            if r["kind"] != "file":
                continue
            folder, at, seen, note = [], r["parent"], set(), None
            while at > 1:
                if at in seen or at not in up:
                    note = "folder chain loops" if at in seen else "parent folder is missing"
                    break
                seen.add(at)
                folder.insert(0, up[at][1])
                at = up[at][0]
            data, resource = v._fork(r["data_size"], r["_data"], r["id"]), v._fork(r["resource_size"], r["_resource"], r["id"], 0xFF)
            if len(data) < r["data_size"] or len(resource) < r["resource_size"]:
                note = "extents do not hold the whole fork"
            yield _row("HFS", r["name"], folder, r["type"].encode("mac_roman"), r["creator"].encode("mac_roman"), data, resource, r["created"], r["modified"], note)
        if v.notes:
            yield _row("HFS", v.name, diagnostic="; ".join(v.notes))

    return rows()


VOLUMES = "volume string, name string, blocks bigint, block_size bigint, free bigint, used bigint, next_id bigint, files bigint, folders bigint, root_files bigint, notes array<string>"
RECORDS = "volume string, ordinal bigint, kind string, id bigint, parent bigint, name string, type string, creator string, valence bigint, data_size bigint, resource_size bigint, created bigint, modified bigint"
EXTENTS = "volume string, file bigint, fork string, ordinal bigint, start bigint, count bigint"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}


def tables(files: DataFrame, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(volumes, catalog records, extents) of the files that are HFS volumes."""

    def of(schema: str, rows):
        kinds = [(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")]

        def run(batches):
            for batch in batches:
                for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    v = _open(c or b"")
                    if v is not None:
                        found = [{"volume": p, **r} for r in rows(v)]
                        yield pa.RecordBatch.from_pylist([{k: r.get(k) for k, _ in kinds} for r in found], schema=pa.schema(kinds))

        return files.select(path, content).mapInArrow(run, schema)

    def volume(v):
        for _ in v.records():
            pass
        return [{"name": v.name, "blocks": v.blocks, "block_size": v.block, "free": v.free, "used": v.used_blocks(), "next_id": v.next_id, "files": v.file_count, "folders": v.folder_count, "root_files": v.files_in_root, "notes": v.notes}]

    def extents(v):
        for r in v.records():
            if r["kind"] == "file":
                for fork, record, number in (("data", r["_data"], 0), ("resource", r["_resource"], 0xFF)):
                    for i, (s, n) in enumerate(v.extents(record, r["id"], number)):
                        yield {"file": r["id"], "fork": fork, "ordinal": i, "start": s, "count": n}
        known = {r["id"] for r in v.records() if r["kind"] == "file"} | {3, 4}
        for (fork, id_), parts in v.overflow.items():
            if id_ not in known:
                for i, (_, *p) in enumerate(sorted(parts)):
                    yield from ({"file": id_, "fork": "orphan data" if fork == 0 else "orphan resource", "ordinal": 3 * i + j, "start": s, "count": n} for j, (s, n) in enumerate(zip(p[::2], p[1::2], strict=True)) if n)

    return of(VOLUMES, volume), of(RECORDS, lambda v: v.records()), of(EXTENTS, extents)
