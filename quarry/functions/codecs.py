"""Byte codecs and checksums: PackBits, RLE90, LZSS, BinHex 4.0 text, CRC-16; Arrow batches in and out."""

from __future__ import annotations

import binascii
import re
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters of BinHex 4.0, in order of their six bits.
HQX = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
_BASE64 = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BANNER = b"(This file must be converted with BinHex 4.0)"

_RUN = re.compile(rb"(?s)(.)\1{2,127}")
_RUN90 = re.compile(rb"(?s)\x90|([^\x90])\1{3,254}")


def packbits(data: bytes) -> bytes:
    """Runs of 3 to 128 equal bytes as (257 - n, byte), the rest as literals of up to 128 bytes."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for a in range(at, end, 128):
            part = data[a : min(a + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out += bytes([257 - (m.end() - m.start()), m[1][0]])
        at = m.end()
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    """The reverse; what a cut-off end still gives."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def rle90(data: bytes) -> bytes:
    return _RUN90.sub(lambda m: b"\x90\x00" if m[1] is None else m[1] + b"\x90" + bytes([len(m[0])]), data)


def unrle90(data: bytes) -> bytes:
    out, last = bytearray(), 0
    parts = data.split(b"\x90")
    out += parts[0]
    for p in parts[1:]:
        if not p:
            continue
        if p[0] == 0:
            out.append(0x90)
        elif out:
            last = out[-1]
            out += bytes([last]) * (p[0] - 1)
        out += p[1:]
    return bytes(out)


#: Fixed values of LZSS: size of the ring, where writing begins, lengths of matches; the ring begins full of spaces.
RING, BEGIN, LEAST, MOST = 4096, 4078, 3, 18
_BITS = tuple(1 << b for b in range(8))
#: Keys that the encoder remembers before it drops those it can't use any more.
KEYS = 1 << 16


def lzss(data: bytes) -> bytes:
    """Groups of eight items under a flag byte (lowest bit first): a literal (1), or a match of 12 bits of place in the ring, low byte first, and 4 of length."""
    out, seen, i, n = bytearray(), {}, 0, len(data)
    while i < n:
        group, flags = len(out), 0
        out.append(0)
        for bit in _BITS:
            key = data[i : i + LEAST]
            j, seen[key] = seen.get(key, -RING), i
            if i - j <= RING - MOST and len(key) == LEAST:
                k, longest = LEAST, min(MOST, n - i)
                while k < longest and data[j + k] == data[i + k]:
                    k += 1
                at = BEGIN + j & RING - 1
                out.append(at & 255)
                out.append(at >> 4 & 0xF0 | k - LEAST)
                i += k
            else:
                flags |= bit
                out.append(data[i])
                i += 1
            if i >= n:
                break
        out[group] = flags
        if len(seen) > KEYS:  # places that the ring has lost give no match
            seen = {key: j for key, j in seen.items() if i - j <= RING}
    return bytes(out)


def unlzss(data: bytes, most: int = 1 << 30) -> bytes:
    """The stream ends with its input, a match that the end cuts off is dropped. An error if the output would pass most bytes."""
    out, i, n, whole = bytearray(b" " * RING), 0, len(data), False
    while i < n and not whole:
        flags, i = data[i], i + 1
        for bit in _BITS:
            if flags & bit:
                if i < n:
                    out.append(data[i])
                i += 1
            elif i + 1 < n:
                low, high = data[i], data[i + 1]
                i += 2
                k, back = (high & 15) + LEAST, (BEGIN + len(out) - (low | (high & 0xF0) << 4) - 1 & RING - 1) + 1  # the ring as a distance from the end
                begin = len(out) - back
                out += out[begin : begin + k] if back >= k else (out[begin:] * k)[:k]
            else:
                whole = True
                break
        if len(out) - RING > most:
            raise ValueError("the output is too large")
    return bytes(memoryview(out)[RING:])


def ima4(data: bytes, channels: int = 1) -> list[list[int]]:
    """16-bit samples of each channel from packets of 34 bytes: two of state (the predictor's top nine bits and the step's number), 64 codes of four bits, low ones first."""
    steps = _ima_steps()
    out: list[list[int]] = [[] for _ in range(channels)]
    for p in range(0, len(data) // 34 * 34, 34):
        head = int.from_bytes(data[p : p + 2], "big")
        value, index = head & 0xFF80, min(head & 0x7F, 88)
        value -= 0x10000 if value & 0x8000 else 0
        for byte in data[p + 2 : p + 34]:
            for code in (byte & 15, byte >> 4):
                step = steps[index]
                d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                out[p // 34 % channels].append(value)
    return out


def _ima_steps() -> list[int]:
    """The standard's 89 step sizes."""
    first = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45]
    rest = [50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282]
    last = [1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return first + rest + last


def pcm(data: bytes, bits: int, signed: bool, order: str = "big") -> list[int]:
    """Samples of 8, 16, 24 or 32 bits as signed numbers; a cut-off sample at the end is dropped."""
    n, shift = bits // 8, 0 if signed else 1 << bits - 1
    return [int.from_bytes(data[i : i + n], order, signed=signed) - shift for i in range(0, len(data) // n * n, n)]


def to_hqx(data: bytes) -> bytes:
    """RLE90, then six bits a character, in colons and lines of 64."""
    body = b":" + binascii.b2a_base64(rle90(data), newline=False).rstrip(b"=").translate(bytes.maketrans(_BASE64, HQX)) + b":"
    return BANNER + b"\n\n" + b"\n".join(body[i : i + 64] for i in range(0, len(body), 64)) + b"\n"


def from_hqx(text: bytes) -> bytes | None:
    """The bytes between the colons; null without them or with a character that has no place there."""
    begin = text.find(b":", max(text.find(b"BinHex"), 0))
    end = text.find(b":", begin + 1)
    if begin < 0 or end < 0:
        return None
    chars = b"".join(text[begin + 1 : end].split())
    if chars.translate(None, HQX):
        return None
    chars = chars[: len(chars) - (len(chars) % 4 == 1)].translate(bytes.maketrans(HQX, _BASE64))  # six bits alone are no byte
    return unrle90(binascii.a2b_base64(chars + b"=" * (-len(chars) % 4)))


#: CRC-16: bytes of a block, and about how many bytes of rows are worked on at a time.
BLOCK, GROUP = 128, 1 << 20


@cache
def _crc_tables(polynomial: int, reflected: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a byte makes of a CRC, and what a block of zeros makes of each of the 65,536."""
    table = np.arange(256, dtype=np.uint16) << (0 if reflected else 8)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ polynomial, table >> 1) if reflected else np.where(table & 0x8000, table << 1 ^ polynomial, table << 1)
    table = table.astype(np.uint16)
    past = np.arange(1 << 16, dtype=np.uint16)
    past = past >> 8 ^ table[past & 255] if reflected else past << 8 ^ table[past >> 8]
    for _ in range(BLOCK.bit_length() - 1):
        past = past[past]
    return table, past


def crc16(rows: list[bytes], polynomial: int, reflected: bool) -> np.ndarray:
    """CRC-16 of each row, started at 0. Rows are cut into blocks from their ends (zeros before a row change nothing); all blocks step together, then each row's are joined."""
    if not reflected and polynomial == 0x1021:
        return np.array([binascii.crc_hqx(r, 0) for r in rows], np.int32)
    out, begin, size = np.zeros(len(rows), np.int32), 0, 0
    for i, r in enumerate(rows):
        size += len(r)
        if size >= GROUP or i == len(rows) - 1:
            out[begin : i + 1] = _crc16(rows[begin : i + 1], polynomial, reflected)
            begin, size = i + 1, 0
    return out


def _crc16(rows: list[bytes], polynomial: int, reflected: bool) -> np.ndarray:
    table, past = _crc_tables(polynomial, reflected)
    n = np.array([len(r) for r in rows], np.int64)
    blocks = -(-n // BLOCK)
    data = np.frombuffer(b"".join(x for r in rows for x in (bytes(-len(r) % BLOCK), r)), np.uint8).reshape(-1, BLOCK).T.copy()
    part = np.zeros(data.shape[1], np.uint16)
    for byte in data:
        part = part >> 8 ^ table[(part ^ byte) & 255] if reflected else part << 8 ^ table[part >> 8 ^ byte]
    crc, order, first = np.zeros(len(rows), np.uint16), np.argsort(-blocks, kind="stable"), np.cumsum(blocks) - blocks
    live = len(rows)
    for i in range(int(blocks.max(initial=0))):
        while live and blocks[order[live - 1]] <= i:
            live -= 1
        on = order[:live]
        crc[on] = past[crc[on]] ^ part[first[on] + i]
    return crc


def crc16_column(data: Column, polynomial: int, reflected: bool) -> Column:
    """CRC-16 of bytes (XMODEM: 0x1021, not reflected; ARC: 0xA001, reflected); null stays null."""

    @F.pandas_udf("int")
    def f(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype="Int32")
        some = s.notna().to_numpy()
        if some.any():
            out[some] = crc16([bytes(x) for x in s[some]], polynomial, reflected)
        return out

    return f(data)


CODECS = {"packbits": (packbits, unpackbits), "rle90": (rle90, unrle90), "lzss": (lzss, unlzss), "binhex": (to_hqx, from_hqx)}


def decode(df: DataFrame, codec: str, data: str, out: str) -> DataFrame:
    """df with the decoded bytes; damaged input gives what can be read, or null."""
    f = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else CODECS[codec][1](bytes(x))), "binary")
    return df.withColumn(out, f(data))


def roundtrips(df: DataFrame, id_col: str, data: str) -> DataFrame:
    """(id, n, a flag for each codec: whether its decoder gives back what its encoder was given). Null counts as no bytes."""

    def run(batches):
        for batch in batches:
            n, same = [], {c: [] for c in CODECS}
            for x in batch.column(1):  # one row's bytes at a time
                r = x.as_py() or b""
                n.append(len(r))
                for c, (to, back) in CODECS.items():
                    same[c].append(back(to(r)) == r)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.bool_()) for x in same.values())], names=["id", "n", *CODECS])

    return df.select(F.col(id_col).cast("long"), data).mapInArrow(run, "id bigint, n bigint, " + ", ".join(f"{c} boolean" for c in CODECS)).withColumnRenamed("id", id_col)
