"""Readers of disks and discs: ISO 9660, FAT12/16/32, and text that carries files: uuencode, cue sheets. See containers for the rules."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

from quarry.sources import archives
from quarry.sources.containers import READERS, Row, _row
from quarry.sources.hfs import hfs
from quarry.sources.udif import udif

#: Entries a directory walk yields at most before it says so, and levels it goes down.
ENTRIES, LEVELS = 1_000_000, 64


def _le(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n], "little")


def iso9660(b: bytes) -> Iterator[Row] | None:
    """Volume descriptor at sector 16; directories by extent, each visited once."""
    if b[32769:32774] != b"CD001" or b[32768] != 1:
        return None
    block = _le(b, 32768 + 128, 2) or 2048

    def rows():
        root = b[32768 + 156 : 32768 + 190]
        todo, seen, count = [(_le(root, 2, 4), _le(root, 10, 4), [])], set(), 0
        while todo:
            extent, size, folder = todo.pop()
            if extent in seen or len(folder) > LEVELS:
                yield _row("ISO 9660", "", folder, diagnostic="folder is part of a loop or too deep")
                continue
            seen.add(extent)
            at, end = extent * block, extent * block + size
            if end > len(b):
                yield _row("ISO 9660", "", folder, diagnostic="folder reaches past the end")
            while at < min(end, len(b)):
                n = b[at]
                if n < 34:
                    at = (at // block + 1) * block
                    continue
                r, at = b[at : at + n], at + n
                raw = r[33 : 33 + r[32]]
                if raw in (b"\0", b"\1"):
                    continue
                name, start, length = raw.decode("latin-1").split(";")[0], _le(r, 2, 4), _le(r, 10, 4)
                if r[25] & 2:
                    todo.append((start, length, [*folder, name]))
                    continue
                count += 1
                if count > ENTRIES:
                    yield _row("ISO 9660", diagnostic=f"more than {ENTRIES} entries")
                    return
                yield _row("ISO 9660", name, folder, data=b[start * block : start * block + length], diagnostic=None if start * block + length <= len(b) else "file reaches past the end")

    return rows()


def fat(b: bytes) -> Iterator[Row] | None:
    """FAT12, 16 and 32 with long names; a chain of clusters ends at its mark, at a loop or where it leaves the table."""
    if len(b) < 512 or b[510:512] != b"\x55\xaa" or b[0] not in (0xEB, 0xE9):
        return None
    sector, per, reserved, tables, roots = _le(b, 11, 2), b[13], _le(b, 14, 2), b[16], _le(b, 17, 2)
    if sector not in (512, 1024, 2048, 4096) or per == 0 or per & (per - 1) or not reserved or not 1 <= tables <= 2:
        return None
    total, table = _le(b, 19, 2) or _le(b, 32, 4), _le(b, 22, 2) or _le(b, 36, 4)
    root_at = (reserved + tables * table) * sector
    data_at = root_at + -(-roots * 32 // sector) * sector
    clusters = (total - data_at // sector) // per
    bits = 12 if clusters < 4085 else 16 if clusters < 65525 else 32
    name_of = f"FAT{bits}"

    def following(c: int) -> int:
        at = reserved * sector + c * bits // 8
        v = _le(b, at, 4 if bits == 32 else 2)
        return v & 0x0FFFFFFF if bits == 32 else (v >> 4 if c & 1 else v & 0xFFF) if bits == 12 else v

    def chain(c: int) -> tuple[bytes, str | None]:
        parts, seen = [], set()
        while 2 <= c < clusters + 2:
            if c in seen:
                return b"".join(parts), "chain of clusters loops"
            seen.add(c)
            at = data_at + (c - 2) * per * sector
            parts.append(b[at : at + per * sector])
            c = following(c)
        return b"".join(parts), None if c >= (1 << min(bits, 28)) - 8 or not parts else "chain of clusters is broken"

    def rows():
        todo = [(chain(_le(b, 44, 4))[0] if bits == 32 else b[root_at : root_at + roots * 32], [])]
        count, visited = 0, set()
        while todo:
            folder_bytes, folder = todo.pop()
            long_parts: dict[int, str] = {}
            for at in range(0, len(folder_bytes) - 31, 32):
                e = folder_bytes[at : at + 32]
                if e[0] == 0:
                    break
                if e[0] == 0xE5:
                    long_parts = {}
                    continue
                if e[11] == 0x0F:
                    long_parts[e[0] & 0x1F] = (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace")
                    continue
                short = e[:8].rstrip().decode("cp437") + ("." + e[8:11].rstrip().decode("cp437") if e[8:11].strip() else "")
                name = "".join(long_parts[k] for k in sorted(long_parts)).split("\0")[0] or short
                long_parts = {}
                if e[11] & 8 or short in (".", ".."):
                    continue
                first = _le(e, 26, 2) | (_le(e, 20, 2) << 16 if bits == 32 else 0)
                body, note = chain(first)
                if e[11] & 16:
                    if first in visited or len(folder) >= LEVELS:
                        yield _row(name_of, name, folder, diagnostic="folder is part of a loop or too deep")
                    else:
                        visited.add(first)
                        todo.append((body, [*folder, name]))
                    continue
                count += 1
                if count > ENTRIES:
                    yield _row(name_of, diagnostic=f"more than {ENTRIES} entries")
                    return
                size = _le(e, 28, 4)
                yield _row(name_of, name, folder, data=body[:size], diagnostic=note or (None if len(body) >= size else "file is cut off"))

    return rows()


_BEGIN = re.compile(rb"(?m)^begin(-base64)? [0-7]{3,4} (.+?)\r?$")


def uuencode(b: bytes) -> Iterator[Row] | None:
    """Each 'begin' block of a text, in historical or Base64 form."""
    if not _BEGIN.search(b[:65536]):
        return None

    def rows():
        for m in _BEGIN.finditer(b):
            name = m[2].decode("latin-1")
            lines = b[m.end() :].split(b"\n")[1:]
            out, note = [], "no end line"
            for line in lines:
                line = line.rstrip(b"\r")
                if line in (b"end", b"===="):
                    note = None
                    break
                try:
                    out.append(base64.b64decode(line, validate=True) if m[1] else binascii.a2b_uu(line) if line else b"")
                except (binascii.Error, ValueError):
                    note = "a line can't be decoded"
                    break
            yield _row("uuencode", name, data=b"".join(out), diagnostic=note)

    return rows()


_TRACK = re.compile(r'(?im)^\s*(?:FILE\s+"?(?P<file>[^"\r\n]+?)"?\s+(?P<kind>\w+)\s*$|TRACK\s+(?P<track>\d+)\s+(?P<mode>\S+)\s*$|INDEX\s+(?P<index>\d+)\s+(?P<m>\d+):(?P<s>\d+):(?P<f>\d+)\s*$)')


def cue_sheet(b: bytes) -> Iterator[Row] | None:
    """One row for each track: its mode and its first sector (75 a second)."""
    if len(b) > 1 << 20 or not re.search(rb"(?im)^\s*TRACK\s+\d+\s+\S+", b) or not re.search(rb"(?im)^\s*FILE\s", b):
        return None

    def rows():
        file, track = "", None
        for m in _TRACK.finditer(b.decode("latin-1")):
            if m["file"]:
                file = m["file"]
            elif m["track"]:
                track = (m["track"], m["mode"])
            elif track and int(m["index"]) == 1:
                sector = (int(m["m"]) * 60 + int(m["s"])) * 75 + int(m["f"])
                yield _row("cue sheet", f"Track {int(track[0]):02d}", [file], track[1].encode()[:4], data=str(sector).encode())

    return rows()


#: Probed after the readers of containers.
ALL = [*READERS[:-1], *archives.READERS, udif, hfs, iso9660, fat, READERS[-1], uuencode, cue_sheet]
