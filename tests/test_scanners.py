"""Scanners and decoders on small buffers, with the facts that the reference's own tests state."""

import base64
import gzip
import io
import struct
import zipfile
import zlib

import pytest

from lodeseam import scanners as S
from lodeseam.functions.paths import Pos
from lodeseam.plans.scan import Options, path_query, scanned


def run(buf, **options):
    o = Options(**options)
    return [r for r in scanned(buf, len(buf), Pos(), o, S.enabled(o.enable, o.disable, o.only)) if r[0] != "page"]


def of(rows, recorder):
    return [(r[4], r[5]) for r in rows if r[1] == recorder]


def test_email_at_start():
    assert of(run(b"plain_text_pdf@textedit.com"), "email") == [("0", "plain_text_pdf@textedit.com")]


@pytest.mark.parametrize(("local", "domain", "kept"), [(63, 20, True), (64, 20, True), (65, 20, False), (10, 253, True), (10, 254, False)])
def test_email_lengths(local, domain, kept):
    host = "a" * (domain - 4) + ".com"
    address = f"{'x' * local}@{host}"
    assert len(host) == domain
    assert bool(of(run(f" {address} ".encode()), "email")) is kept


def test_email_needs_left_boundary_and_one_at():
    assert not of(run(b" a..b.cc@example.com and x "), "email")
    assert of(run(b"<someone@example.com>, and more text"), "email") == [("1", "someone@example.com")]


def test_url_trimmed():
    assert of(run(b"see http://www.msn.com&quot; here"), "url") == [("4", "http://www.msn.com")]
    assert ("11", "www.msn.com") in of(run(b"see http://www.msn.com&quot; here"), "domain")


def test_utf16():
    rows = run(b"\x01\x02" + "http://www.example.com/wide ".encode("utf-16-le"))
    assert of(rows, "url") == [("2", "http://www.example.com/wide")]
    assert all(r[7] for r in rows if r[1] == "url")


@pytest.mark.parametrize("number", ["371449635398431", "378282246310005", "4485 1168-1440 7329".replace("-", " ")])
def test_cards(number):
    found = [f for _, f in of(run(f"pay with {number} today, thanks".encode()), "ccn")]
    assert found == ([number] if S.textual.V.valid_card(number) else [])


def test_card_rules():
    valid = S.textual.V.valid_card
    assert valid("378282246310005") and not valid("378282246310006")
    assert not valid("4444444444444448")  # one digit more than seven times
    assert not valid("371449635398431", before="dead")
    assert valid("371449635398431", before="1234")


def test_six_blocks_are_no_card():
    assert not of(run(b" 4111 1111 1111 1111 1111 1111 "), "ccn")


def test_version_is_no_address():
    assert not of(run(b"program version=1.2.3.4 and rest of text"), "domain")
    assert of(run(b"host is at 11.22.33.44 in the rack"), "domain") == [("11", "11.22.33.44")]


def test_ether():
    assert of(run(b"hw 00:1A:2B:3C:4D:5E end of line"), "ether") == [("3", "00:1A:2B:3C:4D:5E")]
    assert not of(run(b"hw 11:11:11:11:22:33 end of line"), "ether")


def test_phone_and_lock():
    rows = run(b"call (215) 555-1212 now; key 111111-222222-333333-444444-555555-666666-777777-888888\n")
    assert ("5", "(215) 555-1212") in of(rows, "telephone")
    assert [r[0] for r in rows if r[1] == "alerts"] == ["alert"]


def test_vin():
    assert S.textual.V.valid_vin("1M8GDM9AXKP042788")
    assert not S.textual.V.valid_vin("1M8GDM9AXKP042789")
    assert of(run(b"the vehicle VIN: 1M8GDM9AXKP042788 was sold"), "vin") == [("17", "1M8GDM9AXKP042788")]
    assert of(run(b"serial#1M8GDM9AXKP042788, x1M8GDM9AXKP042788 (1M8GDM9AXKP042788) 1m8gdm9axkp042788 1M8GDM9AXKP042788z"), "vin") == [("7", "1M8GDM9AXKP042788"), ("46", "1M8GDM9AXKP042788")]

    def with_check(vin):
        return next(v for c in "0123456789X" if S.textual.V.valid_vin(v := vin[:8] + c + vin[9:]) or c == "X")

    assert S.textual.V.valid_vin(with_check("1M8GDM9A0KP04278A")) and not S.textual.V.valid_vin(with_check("1M8GDM9A04P04278A"))
    assert not S.textual.V.valid_vin(with_check("0M8GDM9A0KP042788")) and not S.textual.V.valid_vin(with_check("1M8GDM9A0KP011111"))
    assert not S.textual.V.valid_vin(with_check("1M8GDM9A0K1234567")) and not S.textual.V.valid_vin("1m8gdm9axkp042788")


def test_bitcoin():
    assert S.textual.V.valid_bitcoin("1BoatSLRHtKNngkdXEeobR76b53LETtpyT")
    assert not S.textual.V.valid_bitcoin("1BoatSLRHtKNngkdXEeobR76b53LETtpyU")


def test_json_needs_commas():
    rows = of(run(b'text {"a": 1, "b": [2, 3]} and {"a": 1} text'), "json")
    assert rows == [("5", '{"a": 1, "b": [2, 3]}')]


def test_json_values():
    import json
    import random
    import time

    values = lambda raw: [raw[a:b] for a, b, n in S.textual.json_values(raw) if n >= 2]
    assert values(b'[true, 1, 2] [1, true, 2] {"a": [1,2,3], "b" [4,5,6] x "[7,8,9" ["\\q", 1, [1,2,3]') == [b"[1, true, 2]", b"[1,2,3]", b"[4,5,6]", b"[1,2,3]"]
    assert values(b'{"k": "x [1,2,3] y", oops') == [b"[1,2,3]"] and values(b"[01,2,3]") == values(b'{"a":1,}') == []
    deep = b"[" * 300 + b"1,2,3" + b"]" * 300
    assert values(deep) == [b"[" * 255 + b"1,2,3" + b"]" * 255]
    rnd = random.Random(3)

    def made(d):
        kind = rnd.randrange(7 if d else 5)
        return [1, -2.5e3, "a\\u00e9 \"[", True, None][kind] if kind < 5 else [made(d - 1) for _ in range(rnd.randrange(5))] if kind == 5 else {f"k{i}": made(d - 1) for i in range(rnd.randrange(4))}

    for _ in range(200):
        whole = json.dumps([1, made(4), made(4)]).encode()
        assert values(b"xx " + whole + b"]") == [whole]
    for piece in (b'{"a":[1,2,', b"[", b'{"a', b'["', b"[1,", b'{"a":"[1,2,3]",'):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            list(S.textual.json_values(piece * (n // len(piece))))
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, piece


def test_gps():
    xml = b'<gpx><trkpt lat="1.5" lon="2.5"><ele>10</ele><time>2011-01-01T00:00:00Z</time></trkpt><trkpt lat="3" lon="4"></trkpt></gpx>'
    assert [f for _, f in of(run(xml), "gps")] == ["2011-01-01T00:00:00Z,1.5,2.5,10,,", ",3,4,,,"]


def test_gzip_path():
    packed = gzip.compress(b"hello@world.com is packed here")
    assert of(run(packed), "email") == [("0-GZIP-0", "hello@world.com")]
    assert path_query(b"xx" + packed, "2-GZIP-6").startswith(b"world.com")


def test_gzip_keeps_what_a_damaged_stream_gave():
    packed = gzip.compress(bytes(range(32, 127)) * 50 + b" first@example.com " + bytes(i * 7 % 251 for i in range(9000)))
    assert S.decode.inflated(packed[: len(packed) - 200], 47).startswith(bytes(range(32, 127)))


def test_offsets_shift_with_a_prefix():
    body = b"some text someone@example.com " + gzip.compress(b"inner@example.org inside of it")
    plain = [Pos.parse(p) for p, _ in of(run(body), "email")]
    moved = [Pos.parse(p) for p, _ in of(run(b"\xa5" * 65 + body), "email")]
    assert [p.shifted(65) for p in plain] == moved


def test_zip():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/b.txt", "inner.mail@zip.example.net and more text here")
    rows = run(f.getvalue())
    assert of(rows, "zip")[0] == ("0", "a/b.txt")
    assert of(rows, "email") == [("0-ZIP-0", "inner.mail@zip.example.net")]


def test_base64_and_base16():
    code = base64.b64encode(b"mail to someone.else@example.org today, please. " * 4 + bytes(range(120)))
    lines = b"\n".join(code[i : i + 76] for i in range(0, len(code), 76))
    assert ("7-BASE64-8", "someone.else@example.org") in of(run(b"prefix\n" + lines + b"\n"), "email")
    hexed = (b"x" * 3 + b" writer@example.com " * 5).hex().encode()
    assert of(run(b"--" + hexed, enable=("base16",)), "email")[0][0].startswith("2-BASE16-")


def test_pdf_text():
    page = b"BT (first) Tj [(wo)-20(rd)-300(next)] TJ ET " * 4
    raw = b"%PDF obj stream\r\n" + zlib.compress(page) + b"endstream"
    child = next(S.decode.pdf(S.Page(raw, len(raw))))
    assert child.data.startswith(b"first word next")


def test_xor_and_office():
    hidden = bytes(b ^ 255 for b in b"hidden text for person@example.com here")
    assert of(run(hidden, enable=("xor",)), "email") == [("0-XOR(255)-16", "person@example.com")]
    doc = b"<?xml version='1.0'?><w:p><w:t>one@example.com</w:t></w:p><w:p>two</w:p>"
    assert ("0-MSXML-0", "one@example.com") in of(run(doc), "email")


def test_xpress():
    # Literals a, b, c and a match of six bytes, three back.
    flags = 0b0001 << 28
    data = struct.pack("<I", flags) + b"abc" + struct.pack("<H", (2 << 3) | 3)
    assert S.decode.xpress(data, 9) == b"abcabcabc"


def test_aes_schedule():
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    schedule = S.binary.aes_schedule(key)
    assert schedule[-16:].hex() == "d014f9a8c9ee2589e13f0cc8b6630ca6"
    rows = run(b"some other bytes" + schedule + b"and what follows them")
    assert of(rows, "aes_keys") == [("16", key.hex(" "))]


def test_depth_ends_in_an_alert():
    data = b"deep@example.com is far inside of all this"
    for _ in range(9):
        data = gzip.compress(data)
    rows = run(data)
    assert {r[5] for r in rows if r[0] == "alert"} == {"process_extract: MAX DEPTH REACHED"}
    assert max(r[8] for r in rows) <= 7


def test_gates():
    assert not run(b"ab" * 500)
    assert not run(b"short")


def test_failure_is_an_alert():
    S.REGISTRY["broken"] = S.Scanner("broken", lambda page: 1 / 0)
    try:
        rows = run(b"someone@example.com and more text")
    finally:
        del S.REGISTRY["broken"]
    assert ("0", "scanner=broken") in of(rows, "alerts") and of(rows, "email")


def test_enabled():
    assert "xor" not in [s.name for s in S.enabled()]
    assert [s.name for s in S.enabled(("email",), ("all",))] == ["email"]
    with pytest.raises(KeyError):
        S.enabled(("nothing",))


def pcap():
    ip = bytearray(struct.pack(">BBHHHBBH4s4s", 0x45, 0, 48, 1, 0, 64, 6, 0, bytes([192, 168, 1, 7]), bytes([93, 184, 16, 34])))
    total = 0xFFFF - S.binary.ones_sum(bytes(ip))
    ip[10:12] = struct.pack(">H", total)
    frame = bytes.fromhex("aabbccddeeff0011223344550800") + bytes(ip) + struct.pack(">HH", 1234, 80) + bytes(24)
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 1_300_000_000, 5, len(frame), len(frame)) + frame


def test_packets():
    rows = run(pcap(), carve_mode=2)
    assert {f for _, f in of(rows, "ip")} == {"192.168.1.7", "93.184.16.34"}
    assert all("cksum-ok" in r[6] for r in rows if r[1] == "ip")
    assert of(rows, "tcp")[0][1] == "192.168.1.7:1234 -> 93.184.16.34:80 (TCP)"
    assert "00:11:22:33:44:55" in {f for _, f in of(rows, "ether")}
    assert [r[0] for r in rows if r[1] == "packets"] == ["carved"]


def test_carvers():
    kml = b"<?xml version='1.0'?><kml xmlns='x'><Point/></kml>"
    card = b"BEGIN:VCARD\r\nFN:John\r\nEND:VCARD\r\n"
    db = bytearray(b"SQLite format 3\0" + bytes(84))
    db[16:18], db[28:32] = struct.pack(">H", 512), struct.pack(">I", 2)
    picture = b"Image8\n2 2\n" + bytes(range(12))
    for data, recorder, size in ((kml, "kml_carved", len(kml)), (card, "vcard", len(card) - 1 + 1), (bytes(db).ljust(1024, b"x"), "sqlite_carved", 1024)):
        rows = [r for r in run(b"front matter of it " + data + b" back", carve_mode=2) if r[1] == recorder]
        assert [len(r[11]) for r in rows] == [size], recorder
    assert [r[11][:11] for r in run(b"front matter " + picture, carve_mode=2) if r[1] == "rtti"] == [b"P6\n2 2\n255\n"]


def test_ntfs_records():
    record = bytearray(b"FILE" + struct.pack("<HH", 48, 3) + bytes(1016))
    record[48:50] = record[510:512] = record[1022:1024] = b"\x07\x01"
    rows = [r for r in run(b"\x01" * 16 + b"abcd" + bytes(record) * 2 + b"tail" * 30, carve_mode=2) if r[1] == "ntfsmft_carved"]
    assert [(r[3], len(r[11])) for r in rows] == [(20, 2048)]


def test_utmp():
    record = struct.pack("<ii32s4s32s256s", 7, 1234, b"pts/0", b"ts/0", b"alice", b"10.0.0.5") + bytes(8) + struct.pack("<II", 1_300_000_000, 5) + bytes(36)
    rows = [r for r in run(bytes(16) + record * 2 + b"rest of buffer", carve_mode=2) if r[1] == "utmp_carved"]
    assert len(record) == 384 and [len(r[11]) for r in rows] == [768]


def test_elf_and_link():
    elf = bytearray(b"\x7fELF\x02\x01\x01" + bytes(200))
    elf[16:20] = struct.pack("<HH", 2, 62)
    elf[52:64] = struct.pack("<HHHHHH", 64, 56, 0, 64, 0, 0)
    assert "<machine>X86_64</machine>" in [r for r in run(bytes(elf)) if r[1] == "elf"][0][6]
    link = bytearray(S.binary._LNK + bytes(100))
    assert of(run(bytes(link) + b"some text"), "winlnk") == [("0", "NO_LINKINFO")]


def test_optional_scanners():
    packed = b"<~" + base64.a85encode(b"person@example.com in ascii85 text") + b"~>"
    assert of(run(b"xy" + packed, enable=("ascii85",)), "email") == [("2-ASCII85-0", "person@example.com")]
    head = b"GET /x HTTP/1.1\r\nHost: a.example.com\r\nAccept: */*\r\n"
    assert [f for _, f in of(run(head + b"\r\nrest", enable=("httpheader",)), "httpheader")] == [head.decode().replace("\r\n", "\\015\\012")]
    mail = b"From: a@b.cc\nTo: c@d.ee\nSubject: hello\n\nbody"
    assert len(of(run(mail, enable=("headers",)), "headers")) == 1
    assert of(run(b"say abcdefgh and (bracketed) x", enable=("wordlist",)), "wordlist") == [("4", "abcdefgh"), ("18", "bracketed")]
    assert of(run(b"find me FIND ME and no more", enable=("find",), settings={"find_patterns": ["find me"]}), "find") == [("0", "find me"), ("8", "FIND ME")]
