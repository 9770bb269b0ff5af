"""Escapes, encodings, names and numbers in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def octal_escaped(raw: bytes, backslash: bool = True) -> str:
    """Valid UTF-8 as it is; control characters, other bytes and (if wanted) backslashes as \\ooo."""
    text = raw.decode("utf-8", "surrogateescape")
    return re.sub("[\x00-\x1f\\\\\udc80-\udcff]" if backslash else "[\x00-\x1f\udc80-\udcff]", lambda m: f"\\{ord(m.group()) & 0xFF:03o}", text)


def octal_unescaped(text: str) -> bytes:
    out, at = bytearray(), 0
    for m in re.finditer(r"\\([0-3][0-7]{2})", text):
        out += text[at : m.start()].encode() + bytes([int(m.group(1), 8)])
        at = m.end()
    return bytes(out + text[at:].encode())


def looks_utf16(raw: bytes) -> str | None:
    """"utf-16-le" or "utf-16-be" where a byte order mark or zeros on one side only tell so."""
    if raw[:2] == b"\xff\xfe":
        return "utf-16-le"
    if raw[:2] == b"\xfe\xff":
        return "utf-16-be"
    even, odd = raw[0::2].count(0), raw[1::2].count(0)
    if odd > 1 and not even:
        return "utf-16-le"
    if even > 1 and not odd:
        return "utf-16-be"
    return None


def as_utf8(raw: bytes) -> str:
    """UTF-16 is told by its zeros; all else is escaped where it is not UTF-8."""
    kind = looks_utf16(raw)
    if kind:
        return raw[: len(raw) // 2 * 2].decode(kind, "replace").lstrip("﻿").replace("\x00", "")
    return octal_escaped(raw)


def legacy_hex_to_octal(text: Column) -> Column:
    """\\xHH escapes of old reports as \\ooo."""
    parts = F.split(text, r"\\x(?=[0-9A-Fa-f]{2})", -1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.lit("\\"), F.lpad(F.conv(F.substring(p, 1, 2), 16, 8), 3, "0"), F.substring(p, 3, 2_000_000)))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


#: Characters that never stand in a carved file's name.
UNSAFE = '"*+,/:;<=>?\\[]|$'


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[^\x20-\x7e]|["*+,/:;<=>?\\\[\]|$]', "_")


def safe_name_py(text: str) -> str:
    return re.sub(r"[^\x20-\x7e]", "_", text).translate({ord(c): "_" for c in UNSAFE})


def valid_ascii_name(text: Column) -> Column:
    return text.rlike(r"^[\x20-\x7e]*$")


def xml_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def host_in_url(url: Column) -> Column:
    """What stands between `://` and the next slash."""
    return F.regexp_extract(url, "://([^/]*)", 1)


def host_in_email(email: Column) -> Column:
    return F.when(email.contains("@"), F.regexp_extract(email, "@(.*)$", 1))


def encoding_signature(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]", "")


_SCALE = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def scaled_int(text: str) -> int:
    """`16k`, `4m`, `1G`, `2t`: a whole number with a binary suffix, below 2**63."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgtKMGT]?)\s*", text)
    if not m:
        raise ValueError(text)
    value = int(m.group(1)) << _SCALE[m.group(2).lower()]
    if value >= 1 << 63:
        raise OverflowError(text)
    return value


def filetime_iso(ticks: Column) -> Column:
    """Ticks of 100 ns since 1601 as ISO-8601."""
    return F.date_format(F.timestamp_seconds((ticks / 10_000_000).cast("long") - F.lit(11_644_473_600)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fat_iso(date: int, time: int) -> str | None:
    """FAT date and time words; seconds count by two."""
    year, month, day = 1980 + (date >> 9), (date >> 5) & 15, date & 31
    hour, minute, second = time >> 11, (time >> 5) & 63, (time & 31) * 2
    if not (1 <= month <= 12 and 1 <= day <= 31 and hour < 24 and minute < 60 and second < 60):
        return None
    return f"{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}"


def exif_date_iso(text: Column) -> Column:
    """`2011:03:04 05:06:07` as ISO-8601; anything else as it is."""
    return F.regexp_replace(text, r"^(\d{4})[:/-](\d{1,2})[:/-](\d{1,2})[ T](\d{1,2}):(\d{1,2}):(\d{1,2}).*$", "$1-$2-$3T$4:$5:$6")


def hex_dump(raw: bytes, start: int = 0, width: int = 16) -> str:
    lines = []
    for i in range(0, len(raw), width):
        part = raw[i : i + width]
        shown = "".join(chr(b) if 0x20 <= b < 0x7F else "." for b in part)
        lines.append(f"{start + i:04x}: {part.hex(' ', -2):<{width * 2 + width // 2}} {shown}")
    return "\n".join(lines)
