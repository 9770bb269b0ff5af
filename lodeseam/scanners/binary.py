"""Scanners for binary structures: executables, file system records, links, pictures, packets, keys."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from hashlib import sha1
from xml.sax.saxutils import escape

from ..functions.text import fat_iso
from . import Carved, Found, Page, scanner


def u16(b: bytes, i: int, big: bool = False) -> int:
    return int.from_bytes(b[i : i + 2], "big" if big else "little")


def u32(b: bytes, i: int, big: bool = False) -> int:
    return int.from_bytes(b[i : i + 4], "big" if big else "little")


def u64(b: bytes, i: int, big: bool = False) -> int:
    return int.from_bytes(b[i : i + 8], "big" if big else "little")


def xml(tag: str, fields: dict) -> str:
    return f"<{tag}>" + "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in fields.items() if v not in (None, "")) + f"</{tag}>"


def filetime(ticks: int) -> str | None:
    if not 0 < ticks < 1 << 62:
        return None
    try:
        return (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return None


def places(buf: bytes, sign: bytes, size: int) -> Iterator[int]:
    at = buf.find(sign)
    while 0 <= at < size:
        yield at
        at = buf.find(sign, at + 1)


# Encryption keys.


def _aes_tables() -> tuple[bytes, list[int]]:
    """Substitution box and round constants, from their definition over GF(256)."""
    exp, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box = []
    for i in range(256):
        inv = 0 if not i else exp[(255 - log[i]) % 255]
        s = 0x63
        for k in range(5):
            s ^= ((inv << k) | (inv >> (8 - k))) & 0xFF
        box.append(s)
    rounds, r = [], 1
    for _ in range(10):
        rounds.append(r)
        r = (r << 1) ^ (0x11B if r & 0x80 else 0)
    return bytes(box), rounds


BOX, ROUNDS = _aes_tables()


def aes_schedule(key: bytes) -> bytes:
    """All round keys of a key of 16, 24 or 32 bytes."""
    n = len(key) // 4
    words = [key[4 * i : 4 * i + 4] for i in range(n)]
    for i in range(n, 4 * (n + 7)):
        t = words[-1]
        if i % n == 0:
            t = bytes([BOX[t[1]] ^ ROUNDS[i // n - 1], BOX[t[2]], BOX[t[3]], BOX[t[0]]])
        elif n == 8 and i % n == 4:
            t = bytes(BOX[b] for b in t)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], t, strict=True)))
    return b"".join(words)


@scanner("aes")
def aes(page: Page) -> Iterator[Found]:
    """Key schedules: each second round key is told by the first, which few places pass; those are worked out in full."""
    import numpy as np

    raw = np.frombuffer(page.buf, np.uint8)
    box = np.frombuffer(BOX, np.uint8)
    for size, total in ((16, 176), (24, 208), (32, 240)):
        n = len(raw) - total + 1
        if n <= 0:
            continue
        ok = np.ones(n, bool)
        for j, k in enumerate((1, 2, 3, 0)):
            want = raw[j : j + n] ^ box[raw[size - 4 + k : size - 4 + k + n]] ^ np.uint8(ROUNDS[0] if j == 0 else 0)
            ok &= raw[size + j : size + j + n] == want
        for at in np.flatnonzero(ok).tolist():
            key = page.buf[at : at + size]
            if at < page.size and len(set(key)) >= 4 and aes_schedule(key)[:total] == page.buf[at : at + total]:
                yield Found("aes_keys", at, key.hex(" "), size, f"AES{size * 8}")


# Executables.

#: Machine names.
ELF_MACHINES = {2: "SPARC", 3: "386", 8: "MIPS", 20: "PPC", 21: "PPC64", 22: "S390", 40: "ARM", 42: "SH", 43: "SPARCV9", 50: "IA_64", 62: "X86_64", 183: "AARCH64", 243: "RISCV"}
PE_MACHINES = {0x14C: "I386", 0x8664: "AMD64", 0x1C0: "ARM", 0x1C4: "ARMNT", 0xAA64: "ARM64", 0x200: "IA64", 0x166: "R4000", 0x1F0: "POWERPC"}


@scanner("elf")
def elf(page: Page) -> Iterator[Found]:
    for at in places(page.buf, b"\x7fELF", page.size):
        b = page.buf[at:]
        if len(b) < 64 or b[4] not in (1, 2) or b[5] not in (1, 2):
            continue
        wide, big = b[4] == 2, b[5] == 2
        kind, machine = u16(b, 16, big), u16(b, 18, big)
        if kind not in (0, 1, 2, 3, 4) or machine not in ELF_MACHINES:
            continue
        table = u64(b, 40, big) if wide else u32(b, 32, big)
        base = 52 if wide else 40
        head, size, count, names = (u16(b, base + i, big) for i in (0, 6, 8, 10))
        if head < base + 12 or size % 2 or names > count:
            continue
        sections, needed, strings = [], [], b""
        for i in range(min(count, 1000)):
            s = b[table + i * size : table + (i + 1) * size]
            if len(s) < (64 if wide else 40):
                break
            start, length = (u64(s, 24, big), u64(s, 32, big)) if wide else (u32(s, 16, big), u32(s, 20, big))
            sections.append((u32(s, 0, big), u32(s, 4, big), start, length, u32(s, 40 if wide else 24, big)))
        if names < len(sections):
            strings = b[sections[names][2] : sections[names][2] + sections[names][3]]
        for _, t, start, length, link in sections:
            if t == 6 and link < len(sections):
                texts, step = b[sections[link][2] :][: sections[link][3]], 16 if wide else 8
                for j in range(start, min(start + length, len(b) - step), step):
                    tag, val = (u64(b, j, big), u64(b, j + 8, big)) if wide else (u32(b, j, big), u32(b, j + 4, big))
                    if tag == 1 and val < len(texts):
                        needed.append(texts[val:].split(b"\0", 1)[0].decode("latin-1"))
        labels = [strings[s[0] :].split(b"\0", 1)[0].decode("latin-1") for s in sections if s[0] < len(strings)]
        info = {"class": 64 if wide else 32, "data": "MSB" if big else "LSB", "type": kind, "machine": ELF_MACHINES[machine], "sections": " ".join(x for x in labels if x), "shared_objects": " ".join(needed)}
        yield Found("elf", at, sha1(b[:4096]).hexdigest(), 4096, xml("ELF", info))


def pe_header(b: bytes) -> dict | None:
    """Fields of a portable executable, or None."""
    if b[:2] != b"MZ" or len(b) < 64:
        return None
    pe = u32(b, 60)
    if not 0 < pe < len(b) - 24 or b[pe : pe + 4] != b"PE\0\0":
        return None
    machine, count, stamp, symbols_at, symbols, optional, flags = struct.unpack_from("<HHIIIHH", b, pe + 4)
    if machine not in PE_MACHINES or not 1 <= count <= 256 or symbols > 1_000_000 or (symbols_at and not symbols) or optional % 2:
        return None
    start, sections, size = pe + 24 + optional, [], 0
    for i in range(count):
        s = b[start + 40 * i : start + 40 * i + 40]
        if len(s) < 40:
            break
        name = s[:8].rstrip(b"\0")
        raw, where = u32(s, 16), u32(s, 20)
        if raw >= 512 << 20 or u32(s, 12) >= 1 << 31 or not re.fullmatch(rb"[\x20-\x7e]*", name):
            break
        sections.append((name.decode(), u32(s, 12), u32(s, 8), where, raw))
        size = max(size, where + raw)
    if not sections:
        return None
    magic = u16(b, pe + 24) if optional >= 2 else 0
    folder = pe + 24 + (112 if magic == 0x20B else 96)

    def offset(rva: int) -> int | None:
        return next((rva - a + w for _, a, v, w, r in sections if a <= rva < a + max(v, r)), None)

    libraries = []
    if optional >= 112 and (at := offset(u32(b, folder + 8))):
        for j in range(at, min(at + 20 * 256, len(b) - 20), 20):
            name = offset(u32(b, j + 12)) if u32(b, j + 12) else None
            if name is None or name >= len(b):
                break
            text = b[name : name + 32].split(b"\0", 1)[0]
            if len(text) < 5 or text[-4:-3] != b"." or not re.fullmatch(rb"[\x20-\x7e]+", text):
                break
            libraries.append(text.decode())
    if optional >= 144:
        cert, length = u32(b, folder + 32), u32(b, folder + 36)
        if 0 < cert < 1 << 30 and 0 < length < 1 << 20:
            size = max(size, cert + length)
    return {"machine": PE_MACHINES[machine], "time": stamp, "flags": flags, "magic": magic, "sections": " ".join(s[0] for s in sections), "libraries": " ".join(libraries), "size": size if size <= 1 << 30 else 0}


@scanner("winpe")
def winpe(page: Page) -> Iterator:
    for at in places(page.buf, b"MZ", page.size):
        b = page.buf[at:]
        info = pe_header(b)
        if info:
            yield Found("winpe", at, sha1(b[:4096]).hexdigest(), 4096, xml("PE", info))
            if info["size"] and page.options.get("winpe_carve", True):
                yield Carved("winpe_carved", at, ".winpe", b[: info["size"]])


# Windows records.


def _short_name(raw: bytes) -> str | None:
    base, ext = raw[:8].rstrip(b" "), raw[8:11].rstrip(b" ")
    if not base or any(c < 0x20 or c in b'"*+,./:;<=>?[\\]|' for c in base + ext) or b" " in ext:
        return None
    return (base + (b"." + ext if ext else b"")).decode("latin-1")


def fat_entry(e: bytes) -> dict | None:
    """A directory entry of 32 bytes that is plausible in name, attributes, dates and size."""
    attributes = e[11]
    if attributes & 0xC0 or attributes & 0x0F == 0x0F or bin(attributes & 0x18).count("1") == 2 or e[12] not in (0, 8, 16, 24):
        return None
    name = _short_name((b"_" if e[0] == 0xE5 else e[:1]) + e[1:11])
    if not name or e[0] in (0, 0x20):
        return None
    made, used, changed = fat_iso(u16(e, 16), u16(e, 14)), fat_iso(u16(e, 18), 0), fat_iso(u16(e, 24), u16(e, 22))
    if not changed or not 1980 <= int(changed[:4]) <= 2040 or (u16(e, 16) and not made) or (u16(e, 18) and not used):
        return None
    weird = (e[13] > 199) + (u32(e, 28) > 1 << 31) + (u32(e, 28) == 0 and not attributes & 0x10 and u16(e, 26) != 0) + (not u16(e, 16)) + (attributes == 0)
    if weird > 2:
        return None
    return {"filename": name, "attrib": attributes, "ctime": made, "atime": used and used[:10], "mtime": changed, "startcluster": u16(e, 20) << 16 | u16(e, 26), "filesize": u32(e, 28), "deleted": int(e[0] == 0xE5) or None}


def mft_entry(r: bytes) -> dict | None:
    """Names, times and size of an NTFS file record."""
    if r[:4] != b"FILE" or len(r) < 1024:
        return None
    at, out = u16(r, 20), {"lsn": u64(r, 8), "seq": u16(r, 16), "nlink": u16(r, 18), "inuse": u16(r, 22) & 1}
    while 0 < at < len(r) - 24 and u32(r, at) != 0xFFFFFFFF:
        kind, length = u32(r, at), u32(r, at + 4)
        if length < 24 or at + length > len(r):
            break
        if not r[at + 8]:
            body = r[at + u16(r, at + 20) : at + u16(r, at + 20) + u32(r, at + 16)]
            if kind == 0x10 and len(body) >= 32:
                out |= dict(zip(("crtime_si", "mtime_si", "ctime_si", "atime_si"), (filetime(u64(body, 8 * i)) for i in range(4)), strict=True))
            elif kind == 0x30 and len(body) >= 66:
                out["filename"] = body[66 : 66 + 2 * body[64]].decode("utf-16-le", "replace")
                out |= {"par_ref": u64(body, 0) & 0xFFFFFFFFFFFF, "filesize": u64(body, 48), "crtime_fn": filetime(u64(body, 8))}
            elif kind == 0x80:
                out["filesize"] = len(body)
        elif kind == 0x80:
            out["filesize"] = u64(r, at + 48)
        at += length
    return out if "filename" in out else None


@scanner("windirs")
def windirs(page: Page) -> Iterator[Found]:
    """Directory entries of FAT, at every 32 bytes, and NTFS file records, at every 512."""
    buf, cursor = page.buf, 0
    while cursor + 32 <= len(buf) and cursor < page.size:
        sector, run = buf[cursor : cursor + 512], []
        for i in range(0, len(sector) - 31, 32):
            entry = fat_entry(sector[i : i + 32])
            if not entry:
                if not any(sector[i : i + 32]):
                    break
                if sector[i + 11] != 0x0F:
                    run = []
                    break
                continue
            run.append((cursor + i, entry))
        for at, entry in run:
            yield Found("windirs", at, entry["filename"], 32, xml("fileobject", {"src": "fat", **entry}))
        if buf[cursor : cursor + 4] == b"FILE":
            info = mft_entry(buf[cursor : cursor + 1024])
            if info:
                yield Found("windirs", cursor, info["filename"], 1024, xml("fileobject", {"src": "mft", **info}))
        cursor += 512


_LNK = bytes.fromhex("4c0000000114020000000000c000000000000046")


@scanner("winlnk")
def winlnk(page: Page) -> Iterator[Found]:
    for at in places(page.buf, _LNK, page.size):
        b = page.buf[at : at + (1 << 16)]
        if len(b) < 76:
            continue
        flags = u32(b, 20)
        info = {"crtime": filetime(u64(b, 28)), "atime": filetime(u64(b, 36)), "wtime": filetime(u64(b, 44)), "filesize": u32(b, 52), "flags": flags}
        cursor, path = 76, "NO_LINKINFO"
        if flags & 1:
            cursor += 2 + u16(b, cursor)
        if flags & 2 and cursor + 28 <= len(b):
            link = b[cursor : cursor + u32(b, cursor)]
            if len(link) >= 28:
                if u32(link, 8) & 1:
                    volume = link[u32(link, 12) :]
                    if len(volume) >= 16:
                        info |= {"drive_type": u32(volume, 4), "drive_serial": f"{u32(volume, 8):08x}"}
                    local = link[u32(link, 16) :].split(b"\0", 1)[0]
                    rest = link[u32(link, 24) :].split(b"\0", 1)[0]
                    path = (local + rest).decode("latin-1") or path
                elif u32(link, 8) & 2:
                    net = link[u32(link, 20) :]
                    path = net[u32(net, 8) :].split(b"\0", 1)[0].decode("latin-1") if len(net) >= 12 else path
            cursor += u32(b, cursor)
        for bit, name in ((2, "description"), (3, "relative_path"), (4, "working_dir"), (5, "arguments"), (6, "icon")):
            if flags >> bit & 1 and cursor + 2 <= len(b):
                n, step = u16(b, cursor), 2 if flags & 0x80 else 1
                info[name] = b[cursor + 2 : cursor + 2 + n * step].decode("utf-16-le" if step == 2 else "latin-1", "replace")
                cursor += 2 + n * step
        yield Found("winlnk", at, path, 76, xml("lnk", info))


@scanner("winprefetch")
def winprefetch(page: Page) -> Iterator[Found]:
    """Prefetch files of versions 17 and 23."""
    for sign, os, times, runs in ((b"\x11\0\0\0SCCA", "Windows XP", 0x78, 0x90), (b"\x17\0\0\0SCCA", "Windows 7", 0x80, 0x98)):
        for at in places(page.buf, sign, page.size):
            b = page.buf[at : at + (1 << 20)]
            if len(b) < 0xA0:
                continue
            name = b[0x10:0x4C].decode("utf-16-le", "replace").split("\0", 1)[0]
            files_at, files_size = u32(b, 0x64), u32(b, 0x68)
            files = [x for x in b[files_at : files_at + files_size].decode("utf-16-le", "replace").split("\0") if x]
            info = {"os": os, "filename": name, "header_size": u32(b, 12), "atime": filetime(u64(b, times)), "runs": u32(b, runs), "filenames": " ".join(files[:4096])}
            if name:
                yield Found("winprefetch", at, name, 0x4C, xml("prefetch", info))


# Pictures.

#: Names of common tags of TIFF and EXIF directories.
TAGS = {
    0x10E: "ImageDescription", 0x10F: "Make", 0x110: "Model", 0x112: "Orientation", 0x11A: "XResolution", 0x11B: "YResolution", 0x128: "ResolutionUnit", 0x131: "Software", 0x132: "DateTime",
    0x13B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength",
    0x927C: "MakerNote", 0x9286: "UserComment", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA420: "ImageUniqueID", 0xA431: "BodySerialNumber",
}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 12: "GPSSpeedRef", 13: "GPSSpeed", 17: "GPSImgDirection", 29: "GPSDateStamp"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def tiff_entries(t: bytes) -> dict[str, str] | None:
    """Named entries of a TIFF structure's directories, or None where it is none."""
    if t[:4] not in (b"II*\0", b"MM\0*"):
        return None
    big, out, seen = t[:2] == b"MM", {}, set()

    def value(kind: int, count: int, raw: bytes) -> str:
        if kind == 2:
            return raw.split(b"\0", 1)[0].decode("latin-1").strip()
        if kind in (5, 10):
            return " ".join(f"{u32(raw, 8 * i, big)}/{u32(raw, 8 * i + 4, big)}" for i in range(min(count, 8)))
        if kind in (3, 8):
            return " ".join(str(u16(raw, 2 * i, big)) for i in range(min(count, 16)))
        if kind in (4, 9):
            return " ".join(str(u32(raw, 4 * i, big)) for i in range(min(count, 16)))
        return raw[:64].decode("latin-1").rstrip("\0")

    def walk(at: int, prefix: str, names: dict, depth: int = 0) -> bool:
        if at in seen or depth > 4 or at < 8 or at + 2 > len(t):
            return False
        seen.add(at)
        n = u16(t, at, big)
        if not 0 < n <= 1000:
            return False
        for i in range(n):
            e = t[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(e) < 12:
                break
            tag, kind, count = u16(e, 0, big), u16(e, 2, big), u32(e, 4, big)
            if kind not in _SIZES or count > 1 << 16:
                continue
            size = _SIZES[kind] * count
            raw = e[8 : 8 + size] if size <= 4 else t[u32(e, 8, big) : u32(e, 8, big) + size]
            if tag == 0x8769:
                walk(u32(e, 8, big), prefix.replace("tiff", "exif"), TAGS, depth + 1)
            elif tag == 0x8825:
                walk(u32(e, 8, big), prefix.replace("tiff", "gps"), GPS_TAGS, depth + 1)
            elif tag in names and len(raw) == size:
                out[f"{prefix}.{names[tag]}"] = value(kind, count, raw)
        after = u32(t, at + 2 + 12 * n, big)
        if after and prefix == "ifd0.tiff":
            walk(after, "ifd1.tiff", TAGS, depth + 1)
        return True

    return out if walk(u32(t, 4, big), "ifd0.tiff", TAGS) else None


def _degrees(text: str, ref: str) -> str:
    parts = [float(a) / (float(b) or 1) for a, b in (x.split("/") for x in text.split())]
    return f"{sum(p / 60**i for i, p in enumerate(parts)) * (-1 if ref in ('S', 'W') else 1):.6f}"


def gps_line(tags: dict[str, str]) -> str | None:
    """time, latitude, longitude, altitude, speed, course."""
    g = {k.rpartition(".")[2]: v for k, v in tags.items() if ".gps." in k}
    if "GPSLatitude" not in g or "GPSLongitude" not in g:
        return None
    number = lambda k: "" if k not in g else f"{float(g[k].split('/')[0]) / (float(g[k].split('/')[1]) or 1):g}"
    when = g.get("GPSDateStamp", "").replace(":", "-")
    return ",".join([when, _degrees(g["GPSLatitude"], g.get("GPSLatitudeRef", "")), _degrees(g["GPSLongitude"], g.get("GPSLongitudeRef", "")), number("GPSAltitude"), number("GPSSpeed"), number("GPSImgDirection")])


def jpeg_length(b: bytes) -> tuple[str, int]:
    """COMPLETE, TRUNCATED or CORRUPT, and how many bytes the picture takes."""
    if b[:3] != b"\xff\xd8\xff":
        return "CORRUPT", 0
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return "CORRUPT", at
        mark = b[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark == 0xD9:
            return "COMPLETE", at + 2
        elif mark == 0xDA:
            at += 2 + u16(b, at + 2, True)
            m = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(b, at)
            if not m:
                return "TRUNCATED", len(b)
            at = m.start()
        elif mark in (0x01, *range(0xD0, 0xD8)):
            at += 2
        else:
            size = u16(b, at + 2, True)
            if size < 2:
                return "CORRUPT", at
            at += 2 + size
    return ("COMPLETE", len(b)) if b[-2:] == b"\xff\xd9" else ("TRUNCATED", len(b))


@scanner("exif")
def exif(page: Page) -> Iterator:
    """Pictures: their EXIF tags, where they were taken, and the pictures themselves."""
    for at in places(page.buf, b"\xff\xd8\xff", page.size):
        b = page.buf[at : at + (16 << 20)]
        state, size = jpeg_length(b)
        head = b[:65536]
        start = head.find(b"Exif\0\0")
        tags = tiff_entries(head[start + 6 :]) if 0 <= start < 4096 else None
        if tags:
            yield Found("exif", at, sha1(b[:4096]).hexdigest(), 4096, xml("exif", tags))
            if line := gps_line(tags):
                yield Found("gps", at, line, 4096)
        if state in ("COMPLETE", "TRUNCATED") and 200 <= size and page.options.get("jpeg_carve_mode", 1) and (page.path or page.options.get("jpeg_carve_mode", 1) == 2):
            yield Carved("jpeg_carved", at, ".jpg", b[:size])
    for sign in (b"II*\0", b"MM\0*", b"8BPS\0\1"):
        for at in places(page.buf, sign, page.size):
            if page.buf[max(0, at - 6) : at] == b"Exif\0\0" or sign == b"8BPS\0\1":
                continue
            t = page.buf[at : at + 65536]
            n = u16(t, u32(t, 4, t[:2] == b"MM"), t[:2] == b"MM") if len(t) > 8 else 0
            tags = tiff_entries(t) if 0 < n <= 200 else None
            if tags:
                yield Found("exif", at, sha1(t[:4096]).hexdigest(), 4096, xml("exif", tags))
                if line := gps_line(tags):
                    yield Found("gps", at, line, 4096)


# Network.


def ones_sum(data: bytes) -> int:
    if len(data) % 2:
        data += b"\0"
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total


#: Times to live with which packets leave their source.
LOCAL_TTL = (32, 64, 128, 255)


def dull_ip(a: bytes) -> bool:
    """Addresses that chance makes: reserved, all alike, or palindromes."""
    return a[0] in (0, 10, 127) and a[1:] in (b"\0\0\0", b"\xff\xff\xff") or a[0] >= 240 or len(set(a)) == 1 or a[3] in (0, 255) or a == a[::-1]


def ip4(b: bytes) -> dict | None:
    """An IPv4 packet with TCP or UDP, unfragmented."""
    if len(b) < 28 or b[0] != 0x45 or b[9] not in (6, 17):
        return None
    length = u16(b, 2, True)
    if not 28 <= length <= 8192 or u16(b, 6, True) & 0x3FFF:
        return None
    if dull_ip(b[12:16]) or dull_ip(b[16:20]):
        return None
    return {"src": ".".join(map(str, b[12:16])), "dst": ".".join(map(str, b[16:20])), "ttl": b[8], "proto": b[9], "length": length, "sum_ok": ones_sum(b[:20]) == 0xFFFF, "sport": u16(b, 20, True), "dport": u16(b, 22, True)}


def ip6(b: bytes) -> dict | None:
    if len(b) < 48 or b[0] >> 4 != 6 or b[6] not in (6, 17, 58):
        return None
    length = u16(b, 4, True)
    if not 8 <= length <= 8192 or 40 + length > len(b):
        return None
    pseudo = b[8:40] + struct.pack(">IxxxB", length, b[6])
    if ones_sum(pseudo + b[40 : 40 + length]) != 0xFFFF:
        return None
    import ipaddress

    ports = (u16(b, 40, True), u16(b, 42, True)) if b[6] != 58 else (0, 0)
    return {"src": str(ipaddress.IPv6Address(b[8:24])), "dst": str(ipaddress.IPv6Address(b[24:40])), "ttl": b[7], "proto": b[6], "length": 40 + length, "sum_ok": True, "sport": ports[0], "dport": ports[1]}


def _mac(b: bytes) -> str:
    return b.hex(":").upper()


@scanner("net")
def net(page: Page) -> Iterator:
    """Packets in capture files, in Ethernet frames, and bare; addresses, connections, hardware addresses."""
    buf, taken = page.buf, -1

    def packet(at: int, p: dict, where: str) -> Iterator[Found]:
        note = f"cksum-{'ok' if p['sum_ok'] else 'bad'}"
        for role, a in (("src", p["src"]), ("dst", p["dst"])):
            local = "L" if role == "src" and p["ttl"] in LOCAL_TTL else "R"
            yield Found("ip", at, a, p["length"], f"struct ip {local} ({role}) {note}")
        if p["proto"] == 6:
            yield Found("tcp", at, f"{p['src']}:{p['sport']} -> {p['dst']}:{p['dport']} (TCP)", p["length"], f"{where} size: {p['length']}")

    for sign, order in ((b"\xd4\xc3\xb2\xa1", "<"), (b"\xa1\xb2\xc3\xd4", ">")):
        for at in places(buf, sign, page.size):
            if len(buf) < at + 24:
                continue
            link, cursor = struct.unpack_from(f"{order}I", buf, at + 20)[0], at + 24
            while cursor + 16 <= len(buf):
                sec, usec, kept, size = struct.unpack_from(f"{order}IIII", buf, cursor)
                if usec >= 1_000_000 or not 0 < kept <= 65535 or kept > size or not 0 < sec < 1 << 32:
                    break
                frame = buf[cursor + 16 : cursor + 16 + kept]
                start = 14 if link == 1 else 0
                if link == 1 and len(frame) >= 14:
                    yield Found("ether", cursor + 16, _mac(frame[6:12]), 14, "(ether_shost)")
                    yield Found("ether", cursor + 16, _mac(frame[0:6]), 14, "(ether_dhost)")
                p = ip4(frame[start:]) or ip6(frame[start:])
                if p:
                    yield from packet(cursor + 16 + start, p, "pcap")
                yield Carved(f"packets{'' if link == 1 else f'_linktype_{link}'}", cursor, ".pcap", buf[cursor : cursor + 16 + kept])
                cursor += 16 + kept
                taken = max(taken, cursor)
    for m in re.finditer(rb"\x45\x00(?=..[\x00-\xff]{2}[\x00\x40]\x00.[\x06\x11])", buf, re.DOTALL):
        at = m.start()
        if at < taken or at >= page.size:
            continue
        p = ip4(buf[at : at + 8192])
        if p and p["sum_ok"]:
            if at >= 14 and buf[at - 2 : at] == b"\x08\x00":
                yield Found("ether", at - 14, _mac(buf[at - 8 : at - 2]), 14, "(ether_shost)")
                yield Found("ether", at - 14, _mac(buf[at - 14 : at - 8]), 14, "(ether_dhost)")
            yield from packet(at, p, "ip4")
            taken = at + 20
    for m in re.finditer(rb"\x60[\x00-\xff]{3}[\x00-\x20][\x00-\xff][\x06\x11\x3a]", buf):
        if taken <= m.start() < page.size:
            p = ip6(buf[m.start() : m.start() + 8400])
            if p:
                yield from packet(m.start(), p, "ip6")


# Login records.


def utmp_record(r: bytes, big: bool) -> dict | None:
    kind, pid = (int.from_bytes(r[i : i + 4], "big" if big else "little", signed=True) for i in (0, 4))
    sec, usec = u32(r, 340, big), u32(r, 344, big)
    texts = [r[8:40], r[40:44], r[44:76], r[76:332]]
    if not 1 <= kind <= 9 or pid < 0 or not 0 < sec < 1 << 31 or usec >= 1_000_000 or any(r[364:384]):
        return None
    if any(not re.fullmatch(rb"[\x20-\x7e]*\0*", t) for t in texts):
        return None
    line, _, user, host = (t.rstrip(b"\0").decode() for t in texts)
    return {"type": kind, "pid": pid, "line": line, "user": user, "host": host, "time": sec}
