"""Decoders of resources: (type, data) to text or JSON; the first decoder that knows the type wins, what fails stays raw with a warning."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

Result = tuple[str, str]


def _pascal(b: bytes, at: int) -> tuple[str, int]:
    n = b[at]
    if at + 1 + n > len(b):
        raise ValueError("string is cut off")
    return b[at + 1 : at + 1 + n].decode("mac_roman"), at + 1 + n


def string(b: bytes) -> Result:
    return "txt", _pascal(b, 0)[0]


def string_list(b: bytes) -> Result:
    out, at = [], 2
    for _ in range(struct.unpack_from(">H", b)[0]):
        s, at = _pascal(b, at)
        out.append(s)
    return "json", json.dumps(out, ensure_ascii=False)


def text(b: bytes) -> Result:
    return "txt", b.decode("mac_roman").replace("\r\n", "\n").replace("\r", "\n")


def version(b: bytes) -> Result:
    major, minor, stage, build, region = struct.unpack_from(">BBBBH", b)
    short, at = _pascal(b, 6)
    return "json", json.dumps({"major": int(f"{major:x}", 10), "minor": minor >> 4, "fix": minor & 15, "stage": {0x20: "development", 0x40: "alpha", 0x60: "beta", 0x80: "final"}.get(stage, str(stage)), "build": build, "region": region, "short": short, "long": _pascal(b, at)[0]}, ensure_ascii=False)


def color_table(b: bytes) -> Result:
    n = struct.unpack_from(">H", b, 6)[0] + 1 & 0xFFFF
    rows = [struct.unpack_from(">HHHH", b, 8 + 8 * i) for i in range(n)]
    return "json", json.dumps([{"value": v, "color": f"#{r >> 8:02x}{g >> 8:02x}{u >> 8:02x}"} for v, r, g, u in rows])


def styles(b: bytes) -> Result:
    n = struct.unpack_from(">H", b)[0]
    rows = [struct.unpack_from(">IHHHBxHHHH", b, 2 + 20 * i) for i in range(n)]
    return "json", json.dumps([{"start": s, "font": f, "face": face, "size": z, "color": f"#{r >> 8:02x}{g >> 8:02x}{u >> 8:02x}"} for s, _, _, f, face, z, r, g, u in rows])


def menu(b: bytes) -> Result:
    id_, _, _, _, _, flags = struct.unpack_from(">hHHhHI", b)
    title, at = _pascal(b, 14)
    items = []
    while at < len(b) and b[at]:
        name, at = _pascal(b, at)
        icon, key, mark, style = b[at : at + 4]
        items.append({"name": name, "icon": icon, "key": chr(key) if key else None, "mark": mark, "style": style, "enabled": bool(flags >> min(len(items) + 1, 31) & 1)})
        at += 4
    return "json", json.dumps({"id": id_, "title": title, "items": items}, ensure_ascii=False)


def window(b: bytes) -> Result:
    *rect, proc, visible, close, ref = struct.unpack_from(">hhhhhBxBxI", b)
    return "json", json.dumps({"bounds": rect, "kind": proc, "visible": bool(visible), "close": bool(close), "reference": ref, "title": _pascal(b, 18)[0]}, ensure_ascii=False)


def size(b: bytes) -> Result:
    flags, preferred, least = struct.unpack_from(">HII", b)
    return "json", json.dumps({"flags": flags, "preferred": preferred, "minimum": least})


def bundle(b: bytes) -> Result:
    owner, id_, n = struct.unpack_from(">4shH", b)
    out, at = [], 8
    for _ in range(n + 1 & 0xFFFF):
        code, k = struct.unpack_from(">4sH", b, at)
        at += 6
        pairs = [struct.unpack_from(">hh", b, at + 4 * i) for i in range(k + 1 & 0xFFFF)]
        at += 4 * len(pairs)
        out.append({"type": code.decode("mac_roman"), "ids": dict(pairs)})
    return "json", json.dumps({"owner": owner.decode("mac_roman"), "id": id_, "types": out})


DECODERS: dict[str, Callable[[bytes], Result]] = {"STR ": string, "STR#": string_list, "TEXT": text, "vers": version, "clut": color_table, "styl": styles, "MENU": menu, "WIND": window, "SIZE": size, "BNDL": bundle}


def decode_one(code: str, data: bytes, own: dict | None = None) -> tuple[str, str | None, str | None]:
    """(extension, content, warning); without a decoder or with bad data: ('bin', null, why)."""
    f = (own or {}).get(code) or DECODERS.get(code)
    if f is None:
        return "bin", None, None
    try:
        return *f(data), None
    except (ValueError, IndexError, struct.error) as e:
        return "bin", None, str(e) or type(e).__name__


def decode(resources: DataFrame, type_col: str = "type", data_col: str = "data", own: dict | None = None) -> DataFrame:
    """resources with extension, content and warning; own decoders come before the built-in ones."""
    from pyspark.sql import types as T

    new = [T.StructField(n, T.StringType()) for n in ("extension", "content", "warning")]
    names = [*resources.columns, *(f.name for f in new)]
    at, body = resources.columns.index(type_col), resources.columns.index(data_col)

    def run(batches):
        for batch in batches:
            rows = [decode_one(c or "", d or b"", own) for c, d in zip(batch.column(at).to_pylist(), batch.column(body).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], names=names)

    return resources.mapInArrow(run, T.StructType([*resources.schema.fields, *new]))
