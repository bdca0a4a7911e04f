"""Resources as source text: 'data' statements of hex, written and compiled."""

from __future__ import annotations

import re

Resource = tuple[str, int, str | None, int, bytes]


def _quote(text: str, quote: str) -> str:
    out = "".join(f"\\0x{b:02X}" if b < 32 or b > 126 else "\\" + chr(b) if chr(b) in (quote, "\\") else chr(b) for b in text.encode("mac_roman", "replace"))
    return quote + out + quote


def write(resources: list[Resource]) -> str:
    """One data statement for each resource: type, id, name and attributes where there are any, sixteen bytes to a line."""
    out = []
    for code, number, name, attributes, data in resources:
        head = [str(number), *([_quote(name, '"')] if name is not None else []), *([f"${attributes:02X}"] if attributes else [])]
        lines = []
        for i in range(0, len(data), 16):
            part = data[i : i + 16]
            pairs = " ".join(part[j : j + 2].hex().upper() for j in range(0, len(part), 2))
            lines.append(f'\t$"{pairs}"')
        out.append(f"data {_quote(code, chr(39))} ({', '.join(head)}) {{\n" + "".join(line + "\n" for line in lines) + "};\n")
    return "\n".join(out)


_TOKEN = re.compile(r"""\s+|/\*.*?\*/|//[^\n]*|(?P<hex>\$"[0-9A-Fa-f\s]*")|(?P<string>"(?:\\.|[^"\\])*")|(?P<type>'(?:\\.|[^'\\])*')|(?P<number>-?\d+|\$[0-9A-Fa-f]+|0x[0-9A-Fa-f]+)|(?P<word>[A-Za-z]+)|(?P<sign>[(),{};])""", re.S)
_FLAGS = {"sysheap": 64, "purgeable": 32, "locked": 16, "protected": 8, "preload": 4}


class RezError(ValueError):
    """A text that does not compile; says the line."""


def _plain(token: str) -> str:
    return bytes(int(m[1], 16) if m[1] else ord(m[2] or m[0]) for m in re.finditer(r"\\0x([0-9A-Fa-f]{2})|\\(.)|.", token[1:-1], re.S)).decode("mac_roman")


def compile_text(text: str) -> list[Resource]:
    """The resources of data statements; any error gives no resource at all."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RezError(f"line {text.count(chr(10), 0, at) + 1}: unexpected character")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0], at))
        at = m.end()
    out, i = [], 0

    def take(*kinds: str) -> str:
        nonlocal i
        if i >= len(tokens) or (tokens[i][0] not in kinds and tokens[i][1] not in kinds):
            where = text.count("\n", 0, tokens[i][2]) + 1 if i < len(tokens) else text.count("\n") + 1
            raise RezError(f"line {where}: expected {' or '.join(kinds)}")
        i += 1
        return tokens[i - 1][1]

    def number(t: str) -> int:
        return int(t[1:], 16) if t[0] == "$" else int(t, 0)

    while i < len(tokens):
        take("data")
        code = _plain(take("type"))
        take("(")
        id_, name, attributes = number(take("number")), None, 0
        while take(",", ")") == ",":
            t = take("string", "number", "word")
            if t[0] == '"':
                name = _plain(t)
            elif t[0].isalpha():
                attributes |= _FLAGS.get(t.lower(), 0)
            else:
                attributes |= number(t)
        take("{")
        data = b""
        while tokens[i : i + 1] and tokens[i][0] in ("hex", "string"):
            t = take("hex", "string")
            data += bytes.fromhex("".join(t[2:-1].split())) if t[0] == "$" else _plain(t).encode("mac_roman")
        take("}")
        take(";")
        out.append((code, id_, name, attributes, data))
    return out
