"""Tests of what patterns find: card numbers, phones, addresses, vehicle numbers."""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Issuer prefixes by number length, as (first digits from, to).
ISSUERS = {
    13: [(4, 4)],
    14: [(3000, 3050), (3600, 3999)],
    15: [(2014, 2014), (2149, 2149), (3400, 3499), (3700, 3799)],
    16: [
        (3528, 3589), (4000, 4999), (5100, 5999), (560221, 560225), (5610, 5610), (6011, 6011), (622126, 622925), (624000, 626999),
        (628200, 628899), (6304, 6304), (6334, 6334), (6706, 6706), (6709, 6709), (6767, 6767), (6771, 6771), (6440, 6499), (6500, 6599),
    ],
    17: [(622126, 622925), (624000, 626999), (628200, 628899), (6304, 6304), (6706, 6706), (6709, 6709), (6771, 6771)],
    18: [(622126, 622925), (624000, 626999), (628200, 628899), (6304, 6304), (6334, 6334), (6706, 6706), (6709, 6709), (6767, 6767), (6771, 6771)],
    19: [(622126, 622925), (624000, 626999), (628200, 628899), (6304, 6304), (6334, 6334), (6706, 6706), (6709, 6709), (6767, 6767), (6771, 6771)],
}


def luhn(number: str) -> bool:
    values = [int(c) for c in reversed(number)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def issuer_ok(number: str) -> bool:
    return any(low <= int(number[: len(str(low))]) <= high for low, high in ISSUERS.get(len(number), ()))


def _group(number: str, i: int) -> int:
    return int(number[i : i + 4] or 0)


def valid_card(found: str, before: str = "", after: str = "") -> bool:
    """A card number as found, with what stands right before and after it.

    Separators number none, three for numbers that begin with 4 or 5, or two for those that begin with 3.
    """
    number = re.sub("[^0-9]", "", found)
    separators = len(found) - len(number)
    if len(found) > 19 or separators and (number[:1], separators) not in (("4", 3), ("5", 3), ("3", 2)):
        return False
    if not issuer_ok(number) or not luhn(number):
        return False
    a, b, c, d = (_group(number, i) for i in (0, 4, 8, 12))
    counts = [number.count(x) for x in "0123456789"]
    if b - a == c - d or max(counts) > 7 or sum(n > 4 for n in counts) >= 2:
        return False
    sea = re.compile(r"[0-9A-Fa-f]{4}")
    return not any(sea.fullmatch(s) and not s.isdigit() for s in (before[-4:], after[:4]))


def card_digits_ok(number: Column) -> Column:
    """valid_card() for bare digits, without their surroundings."""
    prefixes = functools.reduce(
        lambda x, y: x | y,
        [(F.length(number) == n) & functools.reduce(lambda x, y: x | y, [F.substring(number, 1, len(str(a))).try_cast("int").between(a, b) for a, b in ranges]) for n, ranges in ISSUERS.items()],
    )
    part = lambda i: F.coalesce(F.substring(number, i + 1, 4).try_cast("int"), F.lit(0))
    counts = [F.length(number) - F.length(F.replace(number, F.lit(str(k)), F.lit(""))) for k in range(10)]
    many = functools.reduce(lambda x, y: x + y, [F.when(c > 4, 1).otherwise(0) for c in counts])
    return F.coalesce(prefixes & F.call_function("luhn_check", number) & (part(4) - part(0) != part(8) - part(12)) & (F.greatest(*counts) <= 7) & (many < 2), F.lit(False))


def valid_email(found: Column) -> Column:
    """No two dots in a row, one @, at most 64 characters before and 253 after it."""
    return ~found.contains("..") & (F.length(found) - F.length(F.replace(found, F.lit("@"), F.lit(""))) == 1) & (F.instr(found, "@") - 1 <= 64) & (F.length(F.substring_index(found, "@", -1)) <= 253)


def valid_email_py(found: str) -> bool:
    local, at, domain = found.partition("@")
    return bool(at) and "@" not in domain and ".." not in found and len(local) <= 64 and len(domain) <= 253


def valid_ether(found: Column) -> Column:
    """Four different octets at least, and none of the addresses that examples use."""
    return ~found.isin("00:00:00:00:00:00", "00:11:22:33:44:55") & (F.size(F.array_distinct(F.split(found, ":"))) >= 4)


def valid_quad(found: Column) -> Column:
    parts = F.split(found, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.try_cast("int").between(0, 255), F.lit(False)))


#: What an address preceded by it is no address but a version number.
VERSION_SIGNS = {0: ("rsion", "ion=", "PSW/", "flash=", "stone=", "/2001,", "TI_SZ"), 4: (">=", "<=", "<<", "ver", "Ver", "VER", "NSS"), 5: ("v.", "v ", "rv:")}


def ignored_quad(before: str, found: str) -> bool:
    """Whether the eight characters before a dotted quad tell that it is no address."""
    left = before[-8:].rjust(8)
    return (
        left[7].isalnum()
        or left[7] in ".-+"
        or bool(re.fullmatch("[0-9A-Fa-f]{3}}", left[4:]))
        or found.startswith("0.")
        or any(s in left[at:] for at, signs in VERSION_SIGNS.items() for s in signs)
    )


def ignored_quad_expr(before: Column, found: Column) -> Column:
    left = F.lpad(F.substring(before, -8, 8), 8, " ")
    signs = functools.reduce(lambda x, y: x | y, [F.substring(left, at + 1, 8).contains(s) for at, group in VERSION_SIGNS.items() for s in group])
    return left.rlike(r"[A-Za-z0-9.+-]\z") | left.rlike(r"[0-9A-Fa-f]{3}\}\z") | found.startswith("0.") | signs


def valid_phone(before: bytes, after: bytes) -> bool:
    """Phones between nothing but digits, blanks and brackets, or before a further number, are table cells."""
    plain = b"0123456789 \t\n\r\v\f[]<Z.lj"
    if len(before) >= 8 and all(c in plain for c in before[-8:]):
        return False
    if re.match(rb" [0-9][^ ]{0,6}(?<=[0-9]) ", after[:9]):
        return False
    return not re.match(rb"-[0-9]", after)


def valid_phone_expr(before: Column, after: Column) -> Column:
    return ~(before.rlike(r"[0-9\s\[\]<Z.lj]{8}$")) & ~after.rlike(r"^ [0-9][^ ]{0,6}(?<=[0-9]) ") & ~after.rlike("^-[0-9]")


def valid_ssn(found: str) -> bool:
    d = re.sub("[^0-9]", "", found)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def valid_bitcoin(found: str) -> bool:
    """Base 58 of 25 bytes that end in the first four of the doubled SHA-256 of the rest."""
    value = 0
    for c in found:
        if c not in _BASE58:
            return False
        value = value * 58 + _BASE58.index(c)
    if value >> 200:
        return False
    raw = value.to_bytes(25, "big")
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


#: positions' weights, letters' values and the year letters of vehicle identification numbers.
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_VALUES = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", (1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9), strict=True)) | {str(i): i for i in range(10)}
VIN_YEARS = "ABCDEFGHJKLMNPRSTVWXY123456789"


def valid_vin(vin: str) -> bool:
    """Capitals and digits with the right check digit, year and serial number, and no monotonous runs."""
    if len(vin) != 17 or any(c not in VIN_VALUES for c in vin) or vin[0] == "0" or vin[9] not in VIN_YEARS:
        return False
    if vin[9].isdigit() and not vin[11:].isdigit():
        return False
    if vin.isdigit() or re.search(r"(.)\1{4}", vin):
        return False
    steps = "".join("s" if abs(ord(b) - ord(a)) == 1 else "-" for a, b in zip(vin, vin[1:], strict=False))
    if "s" * 6 in steps:
        return False
    rest = sum(w * VIN_VALUES[c] for w, c in zip(VIN_WEIGHTS, vin, strict=True)) % 11
    return vin[8] == ("X" if rest == 10 else str(rest))


def ipv4_text_ok(quad: str) -> bool:
    parts = quad.split(".")
    return len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts)
