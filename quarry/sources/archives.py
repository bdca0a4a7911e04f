"""Readers of archives and older volumes: LHA, StuffIt 1 (stored, RLE90, Huffman), MFS, raw CD sectors, split StuffIt parts."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from quarry.functions.codecs import unrle90
from quarry.sources.containers import Row, _row, _u16, _u32

#: Files of one volume at most; a diagnostic row says that there are more.
MOST = 1_000_000
#: Bytes that one file may expand to.
LARGEST = 1 << 30


class Bits:
    """Bits of some bytes, highest first; zeros after their end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            self.hold = self.hold << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        return self.hold >> self.n - n & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.n -= n
        self.hold &= (1 << self.n) - 1

    def get(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek(n)
        self.skip(n)
        return v

    @property
    def over(self) -> bool:
        return self.at - self.n // 8 > len(self.data) + 4


class Code:
    """A canonical prefix code from code lengths; a lone symbol needs no bits."""

    def __init__(self, lengths: list[int], only: int | None = None):
        self.only, self.table, code = only, {}, 0
        for size in range(1, max(lengths, default=0) + 1):
            for symbol, n in enumerate(lengths):
                if n == size:
                    self.table[size, code] = symbol
                    code += 1
            code <<= 1
        self.most = max(lengths, default=0)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        for size in range(1, self.most + 1):
            symbol = self.table.get((size, bits.peek(size)))
            if symbol is not None:
                bits.skip(size)
                return symbol
        raise ValueError("no such code")


def _lengths(bits: Bits, count_bits: int, special: int) -> Code:
    """The code of code lengths (or of distances): lengths of three bits, 7 and more in unary; after the third, a count of zeros where special."""
    n = bits.get(count_bits)
    if not n:
        return Code([], bits.get(count_bits))
    out: list[int] = []
    while len(out) < n:
        size = bits.get(3)
        while size >= 7 and bits.get(1):
            size += 1
            if size > 32:
                raise ValueError("a code length is too large")
        out.append(size)
        if len(out) == special:
            out += [0] * bits.get(2)
    return Code(out)


def unlh(data: bytes, size: int, window: int) -> bytes:
    """LZSS with two static Huffman codes for each block (lh4 to lh7); window: bits of its size."""
    bits, out = Bits(data), bytearray()
    place_bits = 5 if window > 14 else 4
    while len(out) < size:
        block = bits.get(16)
        kinds = _lengths(bits, 5, 3)
        n, sizes = bits.get(9), []
        if n:
            while len(sizes) < n:
                c = kinds.read(bits)
                sizes += [0] if c == 0 else [0] * (bits.get(4) + 3) if c == 1 else [0] * (bits.get(9) + 20) if c == 2 else [c - 2]
            symbols = Code(sizes)
        else:
            symbols = Code([], bits.get(9))
        places = _lengths(bits, place_bits, -1)
        if bits.over or not block:
            raise ValueError("the input ends too early")
        for _ in range(block):
            if len(out) >= size:
                break
            c = symbols.read(bits)
            if c < 256:
                out.append(c)
                continue
            p = places.read(bits)
            back = 1 + (p if p < 2 else (1 << p - 1) + bits.get(p - 1))
            if bits.over:
                raise ValueError("the input ends too early")
            for _ in range(c - 253):
                out.append(out[-back] if back <= len(out) else 0x20)
    return bytes(out[:size])


def crc16(data: bytes) -> int:
    """CRC-16 of polynomial A001, lowest bit first."""
    c = 0
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0xA001 if c & 1 else 0)
    return c


LH = {b"-lh0-": None, b"-lz4-": None, b"-lh4-": 12, b"-lh5-": 13, b"-lh6-": 15, b"-lh7-": 16}


def lha(b: bytes) -> Iterator[Row] | None:
    """LHA files of header levels 0 to 2."""
    if len(b) < 22 or b[2:5] not in (b"-lh", b"-lz") or b[6:7] != b"-":
        return None

    def rows():
        at = 0
        while at + 22 <= len(b) and b[at] and b[at + 2 : at + 3] == b"-":
            method, packed, size = b[at + 2 : at + 7], *struct.unpack_from("<II", b, at + 7)
            level, name, folder, crc = b[at + 20], b"", [], 0
            if level < 2:
                n = b[at + 21]
                name, crc = b[at + 22 : at + 22 + n], int.from_bytes(b[at + 22 + n : at + 24 + n], "little")
                begin = at + 2 + b[at]
                extra = begin - 2 if level else len(b)
            else:
                crc, begin, extra = int.from_bytes(b[at + 21 : at + 23], "little"), at + int.from_bytes(b[at : at + 2], "little"), at + 24
            while level and extra + 2 <= len(b) and (n := int.from_bytes(b[extra : extra + 2], "little")):
                kind, body = b[extra + 2 : extra + 3], b[extra + 3 : extra + n]
                if level == 1:
                    begin, packed = begin + n, packed - n
                name = body if kind == b"\x01" else name
                folder = [x.decode("mac_roman") for x in body.split(b"\xff") if x] if kind == b"\x02" else folder
                extra += n
                if n < 3:
                    break
            raw, note, data = b[begin : begin + packed], None, None
            if method == b"-lhd-":
                pass
            elif method not in LH:
                note = f"method {method.decode('latin-1')} is not known"
            else:
                try:
                    data = raw if LH[method] is None else unlh(raw, min(size, LARGEST), LH[method])
                    note = None if crc16(data) == crc else "checksum is wrong"
                except ValueError as e:
                    note = f"can't be decoded: {e}"
            *above, last = name.replace(b"\\", b"/").split(b"/") if name else [b""]
            yield _row("LHA", last.decode("mac_roman"), folder + [x.decode("mac_roman") for x in above if x], data=data, diagnostic=note)
            at = begin + max(packed, 0)

    return rows()


def unhuffman(data: bytes, size: int) -> bytes:
    """A tree in the bits (1: a leaf and its byte), then the bytes' codes."""
    bits = Bits(data)

    def node(depth: int = 0):
        if depth > 256 or bits.over:
            raise ValueError("the tree is damaged")
        return bits.get(8) if bits.get(1) else (node(depth + 1), node(depth + 1))

    tree, out = node(), bytearray()
    while len(out) < size:
        x = tree
        while isinstance(x, tuple):
            x = x[bits.get(1)]
        out.append(x)
        if bits.over:
            raise ValueError("the input ends too early")
    return bytes(out)


#: The signatures of StuffIt archives.
STUFFIT = (b"SIT!", b"ST46", b"ST50", b"ST60", b"ST65", b"STin", b"STi2", b"STi3", b"STi4")


def stuffit(b: bytes) -> Iterator[Row] | None:
    """StuffIt archives of the first kind: headers of 112 bytes, forks stored, in RLE90 or Huffman codes; folders by begin and end entries."""
    if len(b) < 22 or b[:4] not in STUFFIT or b[10:14] != b"rLau":
        return None

    def fork(method: int, raw: bytes, size: int) -> bytes:
        if method == 0:
            return raw
        if method == 1:
            return unrle90(raw)
        if method == 3:
            return unhuffman(raw, min(size, LARGEST))
        raise ValueError(f"method {method} is not known")

    def rows():
        at, folder = 22, []
        while at + 112 <= len(b):
            h = b[at : at + 112]
            rm, dm, name = h[0], h[1], h[3 : 3 + min(h[2], 63)].decode("mac_roman")
            sizes = [_u32(h, k) for k in (84, 88, 92, 96)]  # resource, data, packed resource, packed data
            at += 112
            if dm & 0x7F == 32 or rm & 0x7F == 32:
                folder.append(name)
                continue
            if dm & 0x7F == 33 or rm & 0x7F == 33:
                folder = folder[:-1]
                continue
            notes, forks = [], []
            for what, method, size, packed, crc in (("resource", rm, sizes[0], sizes[2], _u16(h, 100)), ("data", dm, sizes[1], sizes[3], _u16(h, 102))):
                raw, at = b[at : at + packed], at + packed
                try:
                    if method & 0x80:
                        raise ValueError("it is encrypted")
                    if len(raw) < packed:
                        raise ValueError("it is cut off")
                    out = fork(method & 0x0F, raw, size) if size else b""
                    if len(out) != size or crc16(out) != crc:
                        notes.append(f"{what} fork: checksum or size is wrong")
                    forks.append(out)
                except ValueError as e:
                    notes.append(f"{what} fork: {e}")
                    forks.append(None)
            yield _row("StuffIt", name, list(folder), h[66:70], h[70:74], forks[1], forks[0], _u32(h, 76), _u32(h, 80), "; ".join(notes) or None)

    return rows()


def mfs(b: bytes) -> Iterator[Row] | None:
    """Flat volumes: a directory of blocks that no entry crosses, and chains of allocation blocks in a map of 12-bit entries."""
    if len(b) < 1088 or b[1024:1026] != b"\xd2\xd7":
        return None

    def rows():
        info = b[1024:1088]
        start, blocks_of, blocks, size, first = _u16(info, 14), _u16(info, 16), _u16(info, 18), _u32(info, 20), _u16(info, 28) * 512
        if not size or size % 512 or 1088 + (blocks * 3 + 1) // 2 > len(b):
            yield _row("MFS", diagnostic="block size or map is damaged")
            return

        def link(k: int) -> int:
            at = 1088 + (k - 2) * 3 // 2
            return (b[at] & 15) << 8 | b[at + 1] if k & 1 else b[at] << 4 | b[at + 1] >> 4

        def fork(k: int, length: int, notes: list[str]) -> bytes:
            out, seen = bytearray(), set()
            while len(out) < length:
                if not 2 <= k < blocks + 2 or k in seen:
                    notes.append(f"a chain reaches block {k}")
                    break
                seen.add(k)
                out += b[first + (k - 2) * size : first + (k - 1) * size].ljust(size, b"\0")
                k = link(k)
                if k < 2:
                    break
            return bytes(out[:length])

        n = 0
        for block in range(start, min(start + blocks_of, len(b) // 512)):
            at, end = block * 512, block * 512 + 512
            while at - block * 512 < 460 and b[at]:
                if at + 51 + b[at + 50] > end:
                    yield _row("MFS", diagnostic=f"an entry of block {block} runs past it")
                    break
                name, notes = b[at + 51 : at + 51 + b[at + 50]].decode("mac_roman"), []
                data, resource = fork(_u16(b, at + 22), _u32(b, at + 24), notes), fork(_u16(b, at + 32), _u32(b, at + 34), notes)
                n += 1
                if n > MOST:
                    yield _row("MFS", diagnostic=f"more than {MOST} files; reading stopped")
                    return
                yield _row("MFS", name, None, b[at + 2 : at + 6], b[at + 6 : at + 10], data, resource, _u32(b, at + 42), _u32(b, at + 46), "; ".join(notes) or None)
                at += 51 + len(name) + (51 + len(name)) % 2
        if n != _u16(info, 12):
            yield _row("MFS", diagnostic=f"the directory holds {n} files, the volume says {_u16(info, 12)}")

    return rows()


SYNC = b"\0" + b"\xff" * 10 + b"\0"


def raw_cd(b: bytes) -> Iterator[Row] | None:
    """Sectors of 2,352 bytes (synchronisation, address, mode, data): the data of 2,048 bytes of each."""
    if len(b) < 2352 or b[:12] != SYNC or len(b) >= 4704 and b[2352:2364] != SYNC:
        return None
    out, odd = bytearray(), 0
    for at in range(0, len(b) // 2352 * 2352, 2352):
        mode = b[at + 15]
        odd += mode not in (1, 2) or b[at : at + 12] != SYNC
        out += b[at + 16 : at + 2064] if mode != 2 else b[at + 24 : at + 2072]
    return iter([_row("raw CD", "Data track", data=bytes(out), diagnostic=f"{odd} sectors are damaged" if odd else None)])


READERS = [lha, stuffit, mfs, raw_cd]
