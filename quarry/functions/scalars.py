"""Scalar functions on columns: dates, fixed point, sizes, text, names, URLs, HTML, binary fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1904-01-01 00:00:00"
#: Seconds from 1904-01-01 to 1970-01-01.
EPOCH_SECONDS = 2082844800


def mac_date(seconds: Column) -> Column:
    """Unsigned seconds since 1904, local time without zone; 0 is no date."""
    return F.timestamp_add("SECOND", F.nullif(seconds.cast("bigint"), F.lit(0)), F.lit(EPOCH).cast("timestamp_ntz"))


def to_mac_date(ts: Column) -> Column:
    """The unsigned seconds of a date from 1904 to 2040, null outside."""
    s = F.unix_seconds(ts.cast("timestamp")) + EPOCH_SECONDS
    return F.when((s >= 0) & (s < 1 << 32), s)


def fixed(raw: Column) -> Column:
    """16.16 fixed point as a double."""
    return raw.cast("bigint") / F.lit(65536.0)


def to_fixed(x: Column) -> Column:
    """The nearest 16.16 number, halves away from zero, held to the range of 32 bits."""
    raw = F.signum(x) * F.floor(F.abs(x) * 65536 + 0.5)
    return F.least(F.greatest(raw, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("bigint")


def size_bytes(text: Column) -> Column:
    """'10 MiB' and the like in bytes; null for anything else. KB, MB, GB count as KiB, MiB, GiB."""
    n, unit = F.regexp_extract(text, r"(?i)^\s*(\d+)\s*([kmg]?)(i?b)?\s*$", 1), F.upper(F.regexp_extract(text, r"(?i)^\s*(\d+)\s*([kmg]?)(i?b)?\s*$", 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.try_multiply(n.try_cast("bigint"), factor.cast("bigint"))


def unsigned(data: Column, position: int, length: int) -> Column:
    """The big-endian unsigned number of up to 7 bytes at a position from 0; null where the data are too short."""
    return F.when(F.octet_length(data) >= position + length, F.conv(F.hex(F.substring(data, position + 1, length)), 16, 10).cast("bigint"))


def signed(data: Column, position: int, length: int) -> Column:
    u = unsigned(data, position, length)
    return F.when(u >= 1 << (8 * length - 1), u - (1 << 8 * length)).otherwise(u)


_HIGH = "".join(map(chr, range(128, 256)))


def mac_roman(data: Column) -> Column:
    """Bytes in Mac OS Roman as text."""
    return F.translate(F.decode(data, "ISO-8859-1"), _HIGH, _HIGH.encode("latin-1").decode("mac_roman"))


#: What a dump shows for each byte, as ISO-8859-1 character: control characters as dots, Mac OS Roman above 7F.
_SHOWN = {chr(b): "." if b < 0x20 or b == 0x7F else bytes([b]).decode("mac_roman") for b in range(256) if not 0x20 <= b < 0x7F}


def hex_lines(data: Column) -> Column:
    """All bytes as a dump, a line for every 16: offset, upper-case hex pairs in two groups of 8, the bytes as Mac OS Roman (control characters as dots)."""

    def line(i: Column) -> Column:
        b = F.substring(data, i * 16 + 1, F.lit(16))
        pairs = F.rpad(F.regexp_replace(F.hex(b), "(..)", "$1 "), 48, " ")
        shown = F.translate(F.decode(b, "ISO-8859-1"), "".join(_SHOWN), "".join(_SHOWN.values()))
        return F.concat(F.lpad(F.hex(i.cast("bigint") * 16), 8, "0"), F.lit("  "), F.substring(pairs, 1, 24), F.lit(" "), F.substring(pairs, 25, 24), F.lit(" "), shown, F.lit("\n"))

    n = F.octet_length(data)
    return F.when(n == 0, "").when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")), line), ""))


def newlines(text: Column) -> Column:
    """CR LF and CR as LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def host_name(name: Column, longest: int = 60) -> Column:
    """A name that hosts accept: forbidden and control characters as _, no dots or spaces at its end, never empty."""
    safe = F.rtrim(F.regexp_replace(F.regexp_replace(F.substring(name, 1, longest), r'[\x00-\x1F<>:"/\\|?*]', "_"), r"[. ]+$", ""))
    return F.when(safe == "", "_").otherwise(safe)


def escape_type(text: Column) -> Column:
    """A four-character code as text: control characters, DEL and backslash as \\xHH."""
    out = F.replace(text, F.lit("\\"), F.lit("\\x5C"))
    for c in [*range(0x20), 0x7F]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"\\x{c:02X}"))
    return out


def html_title(html: Column) -> Column:
    """The title element's text, blanks collapsed, the common entities decoded; null without one."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title", 1)
    out = F.trim(F.regexp_replace(raw, r"[\s]+", " "))
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    return F.nullif(out, F.lit(""))


def html_charset(html: Column, head: int = 1024) -> Column:
    """The character set that the first characters declare, lower-cased; null without one."""
    return F.nullif(F.lower(F.regexp_extract(F.substring(html, 1, head), r"(?i)<meta[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)), F.lit(""))


def html_meta(html: Column, name: str) -> Column:
    """The content of the meta element of that name (name before content); null without one."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<meta\s+name\s*=\s*[\"']{name}[\"']\s+content\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def html_tags(html: Column) -> Column:
    """Names of the start tags in order, comments and the contents of script and style left out."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)(<(script|style)\b[^>]*>).*?</\2\s*>", "$1")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), F.lower)


def resolve_url(base: Column, link: Column) -> Column:
    """A link relative to a page's path: . and .. resolved; null with a scheme or //, or where .. leads above the root. Query and fragment go."""
    path = F.regexp_replace(link, r"[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    parts = F.filter(F.split(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("ok"))

    def step(acc, p):
        up = p == ".."
        kept = F.when(up, F.slice(acc["a"], F.lit(1), F.greatest(F.size(acc["a"]) - 1, F.lit(0)))).otherwise(F.concat(acc["a"], F.array(p)))
        return F.struct(kept.alias("a"), (acc["ok"] & ~(up & (F.size(acc["a"]) == 0))).alias("ok"))

    return F.when(link.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|//)"), None).otherwise(F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"], F.concat(F.lit("/"), F.array_join(acc["a"], "/")))))
