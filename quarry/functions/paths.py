"""Paths inside catalogs: names between colons or slashes, a backslash before a separator, quotes around a whole type."""

from __future__ import annotations


def split(path: str) -> list[str]:
    """The names. ':' separates if the path has one outside quotes and escapes, else '/'. Empty names are skipped."""
    for separator in ":/":
        names, now, quoted, found, i = [], "", False, False, 0
        while i < len(path):
            c = path[i]
            if c == "\\" and i + 1 < len(path) and path[i + 1] in ":/\\'":
                now, i = now + path[i + 1], i + 2
                continue
            if c == "'":
                quoted = not quoted
            if c == separator and not quoted:
                names.append(now)
                now, found = "", True
            else:
                now += c
            i += 1
        if found or separator == "/":
            return [n for n in [*names, now] if n]
    return []


def join(names: list[str]) -> str:
    """The path of names: the reverse of split for names without quotes."""
    return ":".join(n.replace("\\", "\\\\").replace(":", "\\:").replace("/", "\\/") for n in names) + (":" if len(names) == 1 else "")
