"""Carvers: objects that a buffer holds in whole."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from . import Carved, Page, scanner
from .binary import places, u16, u32, u64, utmp_record


@scanner("kml")
def kml(page: Page) -> Iterator[Carved]:
    for at in places(page.buf, b"<?xml ", page.size):
        start, end = page.buf.find(b"<kml ", at), page.buf.find(b"</kml>", at)
        if at < start < end:
            data = page.buf[at : end + 6]
            try:
                data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            yield Carved("kml_carved", at, ".kml", data)


@scanner("vcard")
def vcard(page: Page) -> Iterator[Carved]:
    for at in places(page.buf, b"BEGIN:VCARD\r", page.size):
        end = page.buf.find(b"END:VCARD\r", at)
        if end > 0:
            data = page.buf[at : end + 11]
            if not re.search(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", data):
                yield Carved("vcard", at, ".vcf", data)


@scanner("sqlite")
def sqlite(page: Page) -> Iterator[Carved]:
    for at in places(page.buf, b"SQLite format 3\0", page.size):
        head = page.buf[at : at + 100]
        if len(head) < 100:
            continue
        size, count = u16(head, 16, True), u32(head, 28, True)
        size = 65536 if size == 1 else size
        if size >= 512 and not size & (size - 1) and 0 < count < 1 << 24:
            yield Carved("sqlite_carved", at, ".sqlite3", page.buf[at : at + size * count])


def _evtx_chunk(c: bytes) -> bool:
    return c[:8] == b"ElfChnk\0" and len(c) == 65536 and u32(c, 40) == 128


@scanner("evtx")
def evtx(page: Page) -> Iterator[Carved]:
    """Event logs: a header with its chunks, chunks without a header (one is made for them), and single records."""
    buf, taken = page.buf, -1
    for at in places(buf, b"ElfFile\0", page.size):
        head = buf[at : at + 4096]
        if len(head) < 4096 or u32(head, 32) != 128 or u16(head, 40) != 4096:
            continue
        n = 0
        while _evtx_chunk(buf[at + 4096 + n * 65536 : at + 4096 + (n + 1) * 65536]):
            n += 1
        yield Carved("evtx_carved", at, "_valid_header.evtx" if n else "_orphan_header.evtx", buf[at : at + 4096 + n * 65536])
        taken = max(taken, at + 4096 + n * 65536)
    for at in places(buf, b"ElfChnk\0", page.size):
        if at < taken or not _evtx_chunk(buf[at : at + 65536]):
            continue
        n = 1
        while _evtx_chunk(buf[at + n * 65536 : at + (n + 1) * 65536]):
            n += 1
        fields = b"ElfFile\0" + (0).to_bytes(8, "little") + (n - 1).to_bytes(8, "little") + u64(buf, at + (n - 1) * 65536 + 32).to_bytes(8, "little")
        fields += (128).to_bytes(4, "little") + (1).to_bytes(2, "little") + (3).to_bytes(2, "little") + (4096).to_bytes(2, "little") + n.to_bytes(2, "little") + bytes(76)
        head = fields + (1).to_bytes(4, "little") + zlib.crc32(fields).to_bytes(4, "little")
        yield Carved("evtx_carved", at, "_noheader.evtx", head.ljust(4096, b"\0") + buf[at : at + n * 65536])
        taken = at + n * 65536
    for at in places(buf, b"**\0\0", page.size):
        size = u32(buf, at + 4)
        if at >= taken and 24 < size <= 65024 and not size % 8 and buf[at + size - 4 : at + size] == buf[at + 4 : at + 8]:
            yield Carved("evtx_carved", at, "_orphan_record", buf[at : at + size])
            taken = at + size


def _fixed_up(r: bytes, sector: int = 512) -> bool:
    """Whether all sectors end in the record's update sequence number."""
    at, n = u16(r, 4), u16(r, 6)
    number = r[at : at + 2]
    return 1 < n <= len(r) // sector + 1 and at + 2 * n <= len(r) and all(r[(i + 1) * sector - 2 : (i + 1) * sector] == number for i in range(n - 1))


def _joined(page: Page, sign: bytes, size: int, recorder: str, ext: str, valid) -> Iterator[Carved]:
    """Neighbouring valid records as one object."""
    at = page.buf.find(sign)
    while 0 <= at < page.size:
        n = 0
        while valid(page.buf[at + n * size : at + (n + 1) * size]):
            n += 1
        if n:
            yield Carved(recorder, at, ext, page.buf[at : at + n * size])
        at = page.buf.find(sign, at + max(1, n * size))


@scanner("ntfsmft")
def ntfs_mft(page: Page) -> Iterator[Carved]:
    yield from _joined(page, b"FILE", 1024, "ntfsmft_carved", ".mft", lambda r: len(r) == 1024 and r[:4] == b"FILE" and _fixed_up(r))


@scanner("ntfsindx")
def ntfs_index(page: Page) -> Iterator[Carved]:
    for at in places(page.buf, b"INDX", page.size):
        r = page.buf[at : at + 4096]
        if len(r) == 4096 and _fixed_up(r):
            # An index of file names holds references to parents after its entries' heads; others are object indexes.
            kind = "INDX" if u32(r, 24) >= 40 and u16(r, 24 + u32(r, 24) + 10) >= 66 else "ObjId-O"
            yield Carved("ntfsindx_carved", at, f"_{kind}", r)


@scanner("ntfslogfile")
def ntfs_log(page: Page) -> Iterator[Carved]:
    yield from _joined(page, b"RCRD", 4096, "ntfslogfile_carved", ".RCRD", lambda r: len(r) == 4096 and r[:4] == b"RCRD" and _fixed_up(r))
    for at in places(page.buf, b"RSTR", page.size):
        r = page.buf[at : at + 4096]
        if len(r) == 4096 and _fixed_up(r):
            yield Carved("ntfslogfile_carved", at, ".RSTR", r)


def usn_size(r: bytes) -> int:
    """Size of a change journal record of version 2 or 4; 0 where it is none."""
    if len(r) < 60:
        return 0
    size, major, minor = u32(r, 0), u16(r, 4), u16(r, 6)
    if size % 8 or minor:
        return 0
    if major == 2 and 60 <= size <= 60 + 512 and u16(r, 58) == 60 and 60 + u16(r, 56) <= size and size - 60 - u16(r, 56) < 8 and u16(r, 56) % 2 == 0 and u64(r, 32) > 0:
        return size
    return size if major == 4 and size in (80, 96, 112) and u16(r, 62) == 16 else 0


@scanner("ntfsusn")
def ntfs_journal(page: Page) -> Iterator[Carved]:
    buf, at = page.buf, 0
    starts = re.compile(rb"(?s)[\x40-\xff]\x00\x00\x00[\x02\x04]\x00\x00\x00|[\x00-\xff][\x01\x02]\x00\x00\x02\x00\x00\x00")
    while (m := starts.search(buf, at)) and m.start() < page.size:
        begin = end = m.start()
        while size := usn_size(buf[end : end + 600]):
            end += size
            # Records never cross a page of the journal; zeros fill what is left of it.
            rest = -(end - begin) % 4096
            if buf[end : end + 4] == b"\0\0\0\0" and rest and usn_size(buf[end + rest : end + rest + 600]):
                end += rest
        if end > begin:
            yield Carved("ntfsusn_carved", begin, ".UsnJrnl-J", buf[begin:end])
        at = max(end, begin + 1)


@scanner("utmp")
def utmp(page: Page) -> Iterator[Carved]:
    """Login records, little or big endian, neighbours joined."""
    buf, at = page.buf, 0
    while at + 384 <= len(buf) and at < page.size:
        n = 0
        big = buf[at] == 0 and buf[at + 1] == 0
        if 1 <= (buf[at + 3] if big else buf[at]) <= 9:
            while at + (n + 1) * 384 <= len(buf) and utmp_record(buf[at + n * 384 : at + (n + 1) * 384], big):
                n += 1
        if n:
            yield Carved("utmp_carved", at, ".utmp", buf[at : at + n * 384])
            at += n * 384
        else:
            at += 8


@scanner("rtti")
def rtti(page: Page) -> Iterator[Carved]:
    """Raw pictures under a header of `Image8`, width and height, as portable pixmaps."""
    for m in re.finditer(rb"Image8\n(\d{1,5}) (\d{1,5})\n", page.buf):
        size = 3 * int(m.group(1)) * int(m.group(2))
        if m.start() < page.size and 0 < size <= len(page.buf) - m.end():
            yield Carved("rtti", m.start(), ".ppm", b"P6\n%s %s\n255\n" % m.groups() + page.buf[m.end() : m.end() + size])
