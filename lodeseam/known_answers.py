"""Queries over small built buffers and tables whose answers are known beforehand; the SQL states the answers.

Buffer cases run twice: as they are, and after 65 bytes of 0xA5. The leading offset of every find moves by 65, offsets
inside decoded buffers stay.
"""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, validators
from .functions.paths import Pos
from .operators import features, histograms, lists
from .plans.scan import Options, path_query, report, scan
from .scanners.decode import xpress
from .sources import images
from .sources.sinks import recorder_counts
from .streaming import scan as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PREFIXES = (0, 65)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int | float):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], names: list[str], kinds: list[str]) -> str:
    """SQL that gives the rows."""
    cast = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))
    if not rows:
        return f"SELECT {', '.join(f'CAST(NULL AS {k}) AS {n}' for n, k in zip(names, kinds, strict=True))} WHERE false"
    body = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)
    return f"SELECT {cast} FROM (VALUES {body}) AS t({', '.join(names)})"


def buffers(spark: SparkSession, buf: bytes, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    rows = [(str(n), bytearray(b"\xa5" * n + buf)) for n in prefixes]
    return images.from_column(spark.createDataFrame(rows, "source string, raw binary"), "raw", "source")


def found(name: str, buf: bytes, recorder: str, expected: list[tuple[str, str]], only: tuple[str, ...] = (), prefixes: tuple[int, ...] = PREFIXES, **options) -> None:
    """A query of (source, pos0, feature) of one recorder, and its answer, given for the buffer without a prefix."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scan(buffers(spark, buf, prefixes), Options(only=only, **options))
        return rows.where(F.col("recorder") == recorder).select("source", "pos0", "feature")

    moved = [(str(n), str(Pos.parse(p).shifted(n)), f) for n in prefixes for p, f in expected]
    QUERIES[f"known_{name}"] = run
    ORACLES[f"known_{name}"] = values(moved, ["source", "pos0", "feature"], ["VARCHAR"] * 3)


def carved(name: str, buf: bytes, recorder: str, expected: list[tuple[str, bytes]], only: tuple[str, ...] = (), prefixes: tuple[int, ...] = PREFIXES, **options) -> None:
    """A query of (source, pos0, size, hash) of carved objects, and its answer."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scan(buffers(spark, buf, prefixes), Options(only=only, carve_mode=2, **options))
        return rows.where((F.col("recorder") == recorder) & (F.col("kind") == "carved")).select("source", "pos0", F.octet_length("data").cast("long").alias("size"), "hash")

    moved = [(str(n), str(Pos.parse(p).shifted(n)), len(x), hashlib.sha1(x).hexdigest()) for n in prefixes for p, x in expected]
    QUERIES[f"known_{name}"] = run
    ORACLES[f"known_{name}"] = values(moved, ["source", "pos0", "size", "hash"], ["VARCHAR", "VARCHAR", "BIGINT", "VARCHAR"])


def answers(name: str, function: Callable, cases: list[tuple], kind: str = "string", sql: str = "VARCHAR") -> None:
    """A query of (k, answer): the function applied to each case's input; a case is (input, answer)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def apply(batches):
            for batch in batches:
                ks = batch.column("k").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([function(cases[k][0]) for k in ks])], names=["k", "answer"])

        return spark.createDataFrame([(k,) for k in range(len(cases))], "k long").mapInArrow(apply, f"k long, answer {kind}")

    QUERIES[f"known_{name}"] = run
    ORACLES[f"known_{name}"] = values([(k, c[1]) for k, c in enumerate(cases)], ["k", "answer"], ["BIGINT", sql])


def columns(name: str, expression: Callable, cases: list[tuple], given: str = "string", sql: str = "VARCHAR") -> None:
    """As answers(), for a function of Columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], f"k long, x {given}")
        return df.select("k", expression(F.col("x")).alias("answer"))

    QUERIES[f"known_{name}"] = run
    ORACLES[f"known_{name}"] = values([(k, c[1]) for k, c in enumerate(cases)], ["k", "answer"], ["BIGINT", sql])


# Text features.

found("email", b"plain_text_pdf@textedit.com and <someone@example.com>, a..b.ccarl@example.com and x", "email", [("0", "plain_text_pdf@textedit.com"), ("33", "someone@example.com")], ("email",))
found("email_wide", b"\x01\x02" + "mail wide@example.com now".encode("utf-16-le") + b"..", "email", [("12", "wide@example.com")], ("email",))
found("url", b"see http://www.msn.com&quot; or https://a.example.org/x?q=1 here", "url", [("4", "http://www.msn.com"), ("32", "https://a.example.org/x?q=1")], ("email",))
found("url_wide", b"\x01\x02" + "http://www.example.com/wide ".encode("utf-16-le") + b"..", "url", [("2", "http://www.example.com/wide")], ("email",))
found("domain_quads", b"host is at 11.22.33.44 in the rack, version=1.2.3.4 and not 0.1.2.3", "domain", [("11", "11.22.33.44")], ("email",))
found("ether", b"hw 00:1A:2B:3C:4D:5E end, not 11:11:11:11:22:33 of 00:11:22:33:44:55", "ether", [("3", "00:1A:2B:3C:4D:5E")], ("email",))
found(
    "rfc822", b"..Date: Mon, 02 Jan 2012 10:11:12 +0100 ..\nSubject: hello there\nHost: a.example.com\nMessage-ID: <x@y.example>\n", "rfc822",
    [("8", "Mon, 02 Jan 2012 10:11:12 +0100"), ("43", "Subject: hello there"), ("64", "Host: a.example.com"), ("84", "Message-ID: <x@y.example>")], ("email",),
)
found("ccn", b"pay 371449635398431 or 378282246310005, not 378282246310006 nor 4111 1111 1111 1111 1111 1111 ..", "ccn", [("4", "371449635398431"), ("23", "378282246310005")], ("accts",))
found("telephone_forms", b"call (215) 555-1212, 215-555-1213; 215.555.1214 ok", "telephone", [("5", "(215) 555-1212"), ("21", "215-555-1213"), ("35", "215.555.1214")], ("accts",))
found("telephone_prefixed", b"x fax: 030 1234567; y mobile: 0171 2345678; z", "telephone", [("2", "fax: 030 1234567"), ("22", "mobile: 0171 2345678")], ("accts",))
found("track2", b"swipe ;4532015112830366=12121011234567890123?", "ccn_track2", [("7", "4532015112830366=12121011234567890123")], ("accts",))
found("bitlocker", b"key 111111-222222-333333-444444-555555-666666-777777-888888\nend", "alerts", [("4", "111111-222222-333333-444444-555555-666666-777777-888888")], ("accts",))
found("pii", b"ssn: 123-45-6789 .. dob: 2001-02-03 .. fedex 1234 5678 9 .. CT.Send.CMD_IDENTIFY From=123456789 To=987654321 .. 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "pii",
      [("0", "ssn: 123-45-6789"), ("20", "dob: 2001-02-03"), ("39", "fedex 1234 5678 9"), ("60", "CT.Send.CMD_IDENTIFY From=123456789 To=987654321"), ("112", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT")], ("accts",))
found("sin", b"sin 123 456 789 and 987-654-321 or 12-3", "sin", [("0", "sin 123 456 789"), ("20", "987-654-321")], ("accts",))
found("box_eater", b"[ 100 200 300 378282246310 ] box [378282246310005] and 4532015112830366 ..", "ccn", [("55", "4532015112830366")], ("accts",))
found("vin", b"the vehicle VIN: 1M8GDM9AXKP042788 was sold, x1M8GDM9AXKP042788, 1m8gdm9axkp042788 ", "vin", [("17", "1M8GDM9AXKP042788")], ("vehicle",))
found(
    "gps", b'..<gpx><trkpt lat="1.5" lon="2.5"><ele>10</ele><time>2011-01-01T00:00:00Z</time></trkpt><trkpt lat="3" lon="4"></trkpt></gpx>', "gps",
    [("7", "2011-01-01T00:00:00Z,1.5,2.5,10,,"), ("88", ",3,4,,,")], ("gps",),
)
found("httplogs", b'..\n10.0.0.7 - - "GET /x HTTP/1.1" 200\n10.0.0.7 "PATCH /x"\nno address GET / x\n', "httplogs", [("3", '10.0.0.7 - - "GET /x HTTP/1.1" 200')], ("httplogs",))
found("json", b'text {"a": 1, "b": [2, 3]} and {"a": 1} text [1,2,oops {"k":[1,2,3]', "json", [("5", '{"a": 1, "b": [2, 3]}'), ("60", "[1,2,3]")], ("json",))
found("facebook", b"." * 3000 + b"navAccountName" + b"." * 1000 + b"pokesText" + b"." * 3000, "facebook", [("952", "." * 2048 + "navAccountName" + "." * 1000 + "pokesText" + "." * 1025)], ("facebook",))
found("find", b"find me FIND ME and no more", "find", [("0", "find me"), ("8", "FIND ME")], ("find",), settings={"find_patterns": ["find me"]})
found("wordlist", b"say abcdefgh and (bracketed) x", "wordlist", [("4", "abcdefgh"), ("18", "bracketed")], ("wordlist",))
_HEAD = b"GET /x HTTP/1.1\r\nHost: a.example.com\r\nAccept: */*\r\n"
found("httpheader", b"xx" + _HEAD + b"\r\nrest", "httpheader", [("2", _HEAD.decode().replace("\r\n", "\\015\\012"))], ("httpheader",))
found("mail_headers", b"\nFrom: a@b.cc\nTo: c@d.ee\nSubject: hello\n\nbody", "headers", [("1", "From: a@b.cc\\012To: c@d.ee\\012Subject: hello\\012")], ("headers",))
found("sha1", b"some bytes to be hashed", "sha1_bufs", [("0", hashlib.sha1(b"some bytes to be hashed").hexdigest())], ("sha1_test",), (0,))


# Binary features.

_KEY = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")


def _aes_schedule(key: bytes) -> bytes:
    """The expanded key, as the standard defines it: for keys of 16, 24 and 32 bytes."""
    box = _sbox()
    n, words = len(key) // 4, [list(key[i : i + 4]) for i in range(0, len(key), 4)]
    power = 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [box[x] for x in w[1:] + w[:1]]
            w[0] ^= power
            power = power << 1 ^ (0x11B if power & 0x80 else 0)
        elif n > 6 and i % n == 4:
            w = [box[x] for x in w]
        words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
    return bytes(x for w in words for x in w)


@functools.cache
def _sbox() -> list[int]:
    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a = a << 1 ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out

    box = []
    for x in range(256):
        inverse = next((y for y in range(256) if times(x, y) == 1), 0)
        box.append(functools.reduce(lambda r, s: r ^ (inverse << s | inverse >> (8 - s)) & 0xFF, range(1, 5), inverse) ^ 0x63)
    return box


for _size in (16, 24, 32):
    _own = bytes((i * 37 + 11) % 256 for i in range(_size)) if _size > 16 else _KEY
    found(f"aes{_size * 8}", b"some other bytes" + _aes_schedule(_own) + b"and what follows them", "aes_keys", [("16", _own.hex(" "))], ("aes",))


def _pcap() -> bytes:
    ip = bytearray(struct.pack(">BBHHHBBH4s4s", 0x45, 0, 48, 1, 0, 64, 6, 0, bytes([192, 168, 1, 7]), bytes([93, 184, 16, 34])))
    total = sum(struct.unpack(">10H", ip))
    ip[10:12] = struct.pack(">H", 0xFFFF - (total % 0xFFFF))
    frame = bytes.fromhex("aabbccddeeff0011223344550800") + bytes(ip) + struct.pack(">HH", 1234, 80) + bytes(24)
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 1_300_000_000, 5, len(frame), len(frame)) + frame


found("net_tcp", _pcap(), "tcp", [("54", "192.168.1.7:1234 -> 93.184.16.34:80 (TCP)")], ("net",))
found("net_ip", _pcap(), "ip", [("54", "192.168.1.7"), ("54", "93.184.16.34")], ("net",))
found("net_ether", _pcap(), "ether", [("40", "00:11:22:33:44:55"), ("40", "AA:BB:CC:DD:EE:FF")], ("net",))
_ELF = bytearray(b"\x7fELF\x02\x01\x01" + bytes(200))
_ELF[16:20] = struct.pack("<HH", 2, 62)
_ELF[52:64] = struct.pack("<HHHHHH", 64, 56, 0, 64, 0, 0)
found("elf", bytes(_ELF), "elf", [("0", hashlib.sha1(bytes(_ELF)).hexdigest())], ("elf",), (0,))
found("winlnk", bytes.fromhex("4c0000000114020000000000c000000000000046") + bytes(100) + b"some text", "winlnk", [("0", "NO_LINKINFO")], ("winlnk",))


# Decoders.

answers("xpress", lambda x: xpress(*x).hex(), [((struct.pack("<I", 1 << 28) + b"abc" + struct.pack("<H", 2 << 3 | 3), 9), b"abcabcabc".hex())])
_PACKED = gzip.compress(b"hello@world.com is packed here", mtime=0)
found("gzip", _PACKED, "email", [("0-GZIP-0", "hello@world.com")], ("gzip", "email"))
found("gzip_twice", b"xx" + gzip.compress(_PACKED, mtime=0), "email", [("2-GZIP-0-GZIP-0", "hello@world.com")], ("gzip", "email"))


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("a/b.txt"), "inner.mail@zip.example.net and more text here", zipfile.ZIP_DEFLATED)
    return out.getvalue()


found("zip_names", _zip(), "zip", [("0", "a/b.txt")], ("zip",))
found("zip_content", _zip(), "email", [("0-ZIP-0", "inner.mail@zip.example.net")], ("zip", "email"))
_CODE = base64.b64encode(b"mail to someone.else@example.org today, please. " * 4 + bytes(range(120)))
_LINES = b"prefix\n" + b"\n".join(_CODE[i : i + 76] for i in range(0, len(_CODE), 76)) + b"\n"
found("base64", _LINES, "email", [(f"7-BASE64-{8 + 48 * i}", "someone.else@example.org") for i in range(4)], ("base64", "email"))
found("base16", b"--" + (b"xxx" + b" writer@example.com " * 5).hex().encode(), "email", [(f"2-BASE16-{4 + 20 * i}", "writer@example.com") for i in range(5)], ("base16", "email"))
found("xor", bytes(b ^ 255 for b in b"hidden text for person@example.com here"), "email", [("0-XOR(255)-16", "person@example.com")], ("xor", "email"), (0,))
found("ascii85", b"xy<~" + base64.a85encode(b"person@example.com in ascii85 text") + b"~>", "email", [("2-ASCII85-0", "person@example.com")], ("ascii85", "email"))


def _deep(levels: int) -> bytes:
    data = b"deep@example.com is far inside of all this"
    for _ in range(levels):
        data = gzip.compress(b"=" * 400 + data, mtime=0)
    return data


found("depth", _deep(9), "alerts", [("-".join(["0", *["GZIP-400"] * 6, "GZIP-0"]), "process_extract: MAX DEPTH REACHED")], ("gzip", "email"))
found("below_depth", _deep(6), "email", [("-".join(["0", *["GZIP-400"] * 6]), "deep@example.com")], ("gzip", "email"))
answers("path_query", lambda x: path_query(x[0], x[1])[:9].decode(), [((b"xx" + _PACKED, "2-GZIP-6"), "world.com"), ((_PACKED, "0-GZIP-0"), "hello@wor"), ((b"plain bytes here", "6"), "bytes her")])


def _pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = b"BT (write to first@example.com) Tj [(wo)-20(rd)-300(next)] TJ ET " * 4
    rows = scan(buffers(spark, b"%PDF obj stream\r\n" + zlib.compress(page) + b"endstream"), Options(only=("pdf", "email")))
    return rows.where("recorder = 'email'").groupBy("source", "feature").agg(F.count("*").alias("n"))


QUERIES["known_pdf"] = _pdf
ORACLES["known_pdf"] = values([("0", "first@example.com", 4), ("65", "first@example.com", 4)], ["source", "feature", "n"], ["VARCHAR", "VARCHAR", "BIGINT"])


# Carvers.

_FRONT = b"front matter of it "
_KML = b"<?xml version='1.0'?><kml xmlns='x'><Point/></kml>"
_CARD = b"BEGIN:VCARD\r\nFN:John\r\nEND:VCARD\r\n"
_PICTURE = bytes(range(12))
carved("kml", _FRONT + _KML + b" back", "kml_carved", [("19", _KML)], ("kml",))
carved("vcard", _FRONT + _CARD + b" back", "vcard", [("19", _CARD)], ("vcard",))
carved("rtti", _FRONT + b"Image8\n2 2\n" + _PICTURE + b" back", "rtti", [("19", b"P6\n2 2\n255\n" + _PICTURE)], ("rtti",))


def _database() -> bytes:
    head = bytearray(b"SQLite format 3\0" + bytes(84))
    head[16:18], head[28:32] = struct.pack(">H", 512), struct.pack(">I", 2)
    return bytes(head).ljust(1024, b"x")


carved("sqlite", _FRONT + _database() + b" back", "sqlite_carved", [("19", _database())], ("sqlite",))


def _record() -> bytes:
    record = bytearray(b"FILE" + struct.pack("<HH", 48, 3) + bytes(1016))
    record[48:50] = record[510:512] = record[1022:1024] = b"\x07\x01"
    return bytes(record)


carved("ntfsmft", b"\x01" * 16 + b"abcd" + _record() * 2 + b"tail" * 30, "ntfsmft_carved", [("20", _record() * 2)], ("ntfsmft",))
_LOGIN = struct.pack("<ii32s4s32s256s", 7, 1234, b"pts/0", b"ts/0", b"alice", b"10.0.0.5") + bytes(8) + struct.pack("<II", 1_300_000_000, 5) + bytes(36)
carved("utmp", bytes(16) + _LOGIN * 2 + b"rest of buffer", "utmp_carved", [("16", _LOGIN * 2)], ("utmp",), (0, 64))


# Validators, text, times and numbers.

columns("valid_ether", validators.valid_ether, [("00:1A:2B:3C:4D:5E", True), ("00:00:00:00:00:00", False), ("00:11:22:33:44:55", False), ("11:11:11:11:22:33", False)], sql="BOOLEAN")
answers("valid_bitcoin", validators.valid_bitcoin, [("1BoatSLRHtKNngkdXEeobR76b53LETtpyT", True), ("1BoatSLRHtKNngkdXEeobR76b53LETtpyU", False), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", True), ("", False)], "boolean", "BOOLEAN")
answers("valid_vin", validators.valid_vin, [("1M8GDM9AXKP042788", True), ("1M8GDM9AXKP042789", False), ("1m8gdm9axkp042788", False), ("11111111111111111", False), ("1HGCM82633A004352", True), ("0HGCM82633A004352", False), ("IM8GDM9AXKP042788", False), ("", False)], "boolean", "BOOLEAN")
answers("valid_card", lambda x: validators.valid_card(*x), [(("378282246310005",), True), (("378282246310006",), False), (("4444444444444448",), False), (("371449635398431", "dead"), False), (("371449635398431", "1234"), True)], "boolean", "BOOLEAN")
answers("octal_escape", text.octal_escaped, [(b"plain", "plain"), (b"a\x01b\\c", "a\\001b\\134c"), (b"\xff\xc3\xa9", "\\377é"), (b"\n\t", "\\012\\011"), (b"", "")])
answers("octal_unescape", lambda x: text.octal_unescaped(x).hex(), [("a\\001b\\134c", "6101625c63"), ("é\\377", "c3a9ff"), ("\\9", "5c39")])
answers("looks_utf16", text.looks_utf16, [("wide text".encode("utf-16-le"), "utf-16-le"), ("wide text".encode("utf-16-be"), "utf-16-be"), (b"\xff\xfea\0", "utf-16-le"), (b"narrow", None), (b"a\0", None)])
answers("make_utf8", text.as_utf8, [("wide é".encode("utf-16-le"), "wide é"), (b"\xe9x", "\\351x"), ("é".encode(), "é")])
columns("legacy_escapes", text.legacy_hex_to_octal, [("a\\x41b", "a\\101b"), ("\\xff", "\\377"), ("none", "none"), ("\\xg1", "\\xg1")])
answers("scaled_int", text.scaled_int, [("16k", 16384), ("4m", 4194304), ("1G", 1073741824), ("2t", 2199023255552), ("7", 7)], "long", "BIGINT")
columns("unix_iso", text.unix_iso, [(0, "1970-01-01T00:00:00Z"), (1_300_000_000, "2011-03-13T07:06:40Z")], "long")
columns("filetime_iso", text.filetime_iso, [(116_444_736_000_000_000, "1970-01-01T00:00:00Z"), (129_444_736_000_000_000, "2011-03-13T07:06:40Z")], "long")
answers("fat_iso", lambda x: text.fat_iso(*x), [(((31 << 9) | (3 << 5) | 13, (7 << 11) | (6 << 5) | 20), "2011-03-13T07:06:40"), ((0, 0), None), (((31 << 9) | (13 << 5) | 1, 0), None)])
columns("exif_date", text.exif_date_iso, [("2011:03:04 05:06:07", "2011-03-04T05:06:07"), ("soon", "soon")])
columns("host_in_url", text.host_in_url, [("http://a.example.org/x/y", "a.example.org"), ("ftp://b", "b"), ("none", "")])
columns("host_in_email", text.host_in_email, [("a@b.example", "b.example"), ("none", None)])
columns("encoding_signature", text.encoding_signature, [("849920-GZIP-0-BASE64-17", "-GZIP--BASE-"), ("12", "")])
columns("ascii_name", text.valid_ascii_name, [("plain name", True), ("é", False), ("", True)], sql="BOOLEAN")
answers("hex_dump", text.hex_dump, [(b"A\x00b", "0000: 4100 62                                  A.b")])
answers("position", lambda x: str(Pos.parse(x).shifted(65)), [("10", "75"), ("10-GZIP-3", "75-GZIP-3"), ("0-ZIP-1-GZIP-2", "65-ZIP-1-GZIP-2")])


# Histograms: every declared one, from one table of features.

_FEATURES = [
    ("email", "A@b.example", "", False), ("email", "a@B.example", "", True), ("email", "c@b.example", "", False), ("domain", "b.example", "", False), ("domain", "B.example", "", False),
    ("url", "http://cid-a.b.live.com/x", "", False), ("url", "http://www.facebook.com/profile.php?id=42", "", False), ("url", "http://www.facebook.com/Some.One", "", False),
    ("url", "http://search.example/?q=big+dogs&x=1", "", False), ("ether", "00:1A:2B:3C:4D:5E (d)", "", False), ("ccn", "3782 822463 10005", "", False), ("ccn", "378282246310005", "", False),
    ("ccn_track2", "4532015112830366=12121011234567890123", "", False), ("telephone", "(215) 555-1212", "", False), ("telephone", "215-555-1212", "", False),
    ("pii", "CT.Send.CMD_IDENTIFY From=123456789", "", False), ("pii", "ssn: 1", "", False), ("find", "Word", "", False), ("find", "word", "", False),
    ("ip", "1.2.3.4", "struct ip R (dst) cksum-ok", False), ("ip", "1.2.3.5", "cksum-bad", False), ("tcp", "1.2.3.4:1 -> 1.2.3.5:2 (TCP)", "", False), ("vin", "1M8GDM9AXKP042788", "", False),
]
_URLS = [f for r, f, _, _ in _FEATURES if r == "url"]
_HISTOGRAMS = {
    "email_histogram": [("a@b.example", 2, 1), ("c@b.example", 1, 0)],
    "email_domain_histogram": [("@b.example", 3, 1)],
    "domain_histogram": [("b.example", 1, 0), ("B.example", 1, 0)],
    "url_histogram": [(u, 1, 0) for u in _URLS],
    "url_services": [("://cid-a.b.live.com", 1, 0), ("://www.facebook.com", 2, 0), ("://search.example", 1, 0)],
    "url_facebook-id": [("://www.facebook.com/profile.php?id=42", 1, 0)],
    "url_facebook-address": [("://www.facebook.com/some.one", 1, 0)],
    "url_searches": [("search.example/?q=big+dogs", 1, 0)],
    "ether_histogram": [("00:1A:2B:3C:4D:5E ", 1, 0)],
    "ccn_histogram": [("378282246310005", 2, 0)],
    "ccn_track2_histogram": [("4532015112830366=12121011234567890123", 1, 0)],
    "telephone_histogram": [("2155551212", 2, 0)],
    "pii_teamviewer": [],
    "find_histogram": [("word", 2, 0)],
    "ip_histogram": [("1.2.3.4", 1, 0)],
    "tcp_histogram": [("1.2.3.4:1 -> 1.2.3.5:2 (TCP)", 1, 0)],
    "vin_histogram": [("1M8GDM9AXKP042788", 1, 0)],
}


def _histogram(name: str, expected: list[tuple]) -> None:
    recorder, _, suffix = name.rpartition("_")
    if name == "email_domain_histogram":
        recorder, suffix = "email", "domain_histogram"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame(_FEATURES, "recorder string, feature string, context string, is_utf16 boolean")
        made = histograms.histograms(df).where((F.col("recorder") == recorder) & (F.col("suffix") == suffix))
        return histograms.ordered(made).select("feature", "n", "n_utf16")

    key = "known_" + name.replace("-", "_")
    QUERIES[key] = run
    ORACLES[key] = values(expected, ["feature", "n", "n_utf16"], ["VARCHAR", "BIGINT", "BIGINT"])


for _name, _rows in _HISTOGRAMS.items():
    if _rows:
        _histogram(_name, _rows)


def _numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("t", x) for x in ("100", "200", "300", "200", "300", "foo 300 bar")], "recorder string, feature string")
    return histograms.histogram(df, histograms.Histogram("t", numeric=True)).select("feature", "n")


QUERIES["known_numeric_histogram"] = _numeric
ORACLES["known_numeric_histogram"] = values([("300", 3), ("200", 2), ("100", 1)], ["feature", "n"], ["VARCHAR", "BIGINT"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("t", "s", "key", 2, 1), ("t", "s", "other", 1, 0)], "recorder string, suffix string, feature string, n long, n_utf16 long")
    return histograms.lines(df).select("value")


QUERIES["known_histogram_lines"] = _lines
ORACLES["known_histogram_lines"] = values([("n=2\tkey\t(utf16=1)",), ("n=1\tother",)], ["value"], ["VARCHAR"])


# Reports: lists, duplicates, counts; streams.


def _twice(spark: SparkSession) -> DataFrame:
    rows = [("a", bytearray(_PACKED)), ("b", bytearray(_PACKED)), ("c", bytearray(b"only carl@example.com is in this one"))]
    return images.from_column(spark.createDataFrame(rows, "source string, raw binary"), "raw", "source")


def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_twice(spark), Options(only=("gzip", "email")), dedupe=True).features.where("recorder = 'email'").select("source", "pos0", "feature")


QUERIES["known_dedupe"] = _dedupe
ORACLES["known_dedupe"] = values([("a", "0-GZIP-0", "hello@world.com"), ("c", "5", "carl@example.com")], ["source", "pos0", "feature"], ["VARCHAR"] * 3)


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_twice(spark), Options(only=("gzip", "email"))).duplicates


QUERIES["known_duplicates"] = _duplicates
ORACLES["known_duplicates"] = values(
    [("a|0", "b|0", hashlib.sha1(_PACKED).hexdigest()), ("a|0-GZIP-0", "b|0-GZIP-0", hashlib.sha1(b"hello@world.com is packed here").hexdigest())], ["first_pos0", "dup_pos0", "sha1"], ["VARCHAR"] * 3
)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop, alert = lists.literals(spark, ["hello@world.com"]), lists.literals(spark, ["carl@example.com"])
    found_ = report(_twice(spark), Options(only=("gzip", "email")), stop=stop, alert=alert).features
    return found_.where("feature IN ('hello@world.com', 'carl@example.com')").select("recorder", "source", "feature")


QUERIES["known_lists"] = _listed
ORACLES["known_lists"] = values(
    [("email_stopped", "a", "hello@world.com"), ("email_stopped", "b", "hello@world.com"), ("email", "c", "carl@example.com"), ("ALERTS_found", "c", "carl@example.com")], ["recorder", "source", "feature"], ["VARCHAR"] * 3
)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorder_counts(scan(_twice(spark), Options(only=("gzip", "email")))).where("recorder IN ('email', 'domain')").select("recorder", "n")


QUERIES["known_recorder_counts"] = _counts
ORACLES["known_recorder_counts"] = values([("email", 3), ("domain", 3)], ["recorder", "n"], ["VARCHAR", "BIGINT"])


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows as the stream has them, over a table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return streams.windowed(events).select(F.col("window.start").alias("start"), "event_type", "n")


QUERIES["event_windows"] = _windowed
ORACLES["event_windows"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all users of a long text, over many pages with their margins."""
    body = b"".join(b"user%d@company.com\n" % i for i in range(49_994))
    pages = images.from_column(spark.createDataFrame([("x", bytearray(body))], "source string, raw binary"), "raw", "source", 65_536, 4_096)
    rows = scan(pages, Options(only=("email",))).where("recorder = 'email' AND feature LIKE 'user%'")
    return rows.agg(F.countDistinct("feature").alias("users"))


QUERIES["known_users_across_pages"] = _long
ORACLES["known_users_across_pages"] = values([(49_994,)], ["users"], ["BIGINT"])


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of addresses' lengths, by the native extractor: local part 64, whole domain 253."""
    cases = [(local, domain) for local, domain in ((63, 20), (64, 20), (65, 20), (10, 252), (10, 253), (10, 254))]
    df = spark.createDataFrame([(a, b, " " + "x" * a + "@" + "a" * (b - 4) + ".com ") for a, b in cases], "local long, domain long, t string")
    return features.extract(df, "t", ["email"], ["local", "domain"]).select("local", "domain")


QUERIES["known_email_lengths"] = _native
ORACLES["known_email_lengths"] = values([(63, 20), (64, 20), (10, 252), (10, 253)], ["local", "domain"], ["BIGINT", "BIGINT"])
