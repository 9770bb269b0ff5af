"""Scanners for features in text, as UTF-8 or UTF-16."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from ..functions import validators as V
from ..operators import features as X
from . import Found, Page, scanner

_EMAIL, _URL, _QUAD, _ETHER, _RFC822 = (re.compile(p.encode()) for p in (X.EMAIL, X.URL, X.QUAD, X.ETHER, X.RFC822))
_DOTTED = re.compile(rb"[0-9]\.[0-9]")
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){6,}")


def _host(url: bytes) -> tuple[int, bytes]:
    at = url.find(b"://") + 3
    return at, url[at:].split(b"/", 1)[0]


def trimmed_url(url: bytes) -> bytes:
    """Without a trailing &quot;; where nothing follows the host, up to its last letter."""
    out = url.removesuffix(b"&quot;")
    return re.sub(rb"[^A-Za-z]+\Z", b"", out) if url.count(b"/") == 2 else out


def _mail_and_url(buf: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(recorder, offset, feature) of addresses, URLs and their hosts."""
    if b"@" in buf:
        for m in _EMAIL.finditer(buf):
            if V.valid_email_py(m.group().decode("ascii")):
                yield "email", m.start(), m.group()
                at = m.group().index(b"@") + 1
                yield "domain", m.start() + at, m.group()[at:]
    if b"://" in buf:
        for m in _URL.finditer(buf):
            url = trimmed_url(m.group())
            yield "url", m.start(), url
            at, host = _host(url)
            if host and b"://" in url:
                yield "domain", m.start() + at, host


@scanner("email")
def email(page: Page) -> Iterator[Found]:
    """E-mail addresses, URLs, hosts, dotted quads, Ethernet addresses and mail headers."""
    buf = page.buf
    for recorder, at, feature in _mail_and_url(buf):
        yield Found(recorder, at, feature)
    for m in _QUAD.finditer(buf) if _DOTTED.search(buf) else ():
        if not V.ignored_quad(buf[max(0, m.start() - 8) : m.start()].decode("latin-1"), m.group().decode()):
            yield Found("domain", m.start(), m.group())
    colon = b":" in buf
    for m in _ETHER.finditer(buf) if colon else ():
        parts = m.group().split(b":")
        if len(set(parts)) >= 4 and m.group() not in (b"00:00:00:00:00:00", b"00:11:22:33:44:55"):
            yield Found("ether", m.start(), m.group())
    for m in _RFC822.finditer(buf) if colon else ():
        yield Found("rfc822", m.start(), m.group())
    # Every second byte of a run of UTF-16 text, read as the rest.
    for run in _WIDE.finditer(buf) if b"\0" in buf else ():
        for recorder, at, feature in _mail_and_url(run.group()[::2]):
            yield Found(recorder, run.start() + 2 * at, feature, 2 * len(feature), utf16=True)


_CARD, _TRACK2, _PHONE, _PREFIXED, _PII, _SIN = (re.compile(p.encode()) for p in (X.CARD, X.TRACK2, X.PHONE, X.PREFIXED_PHONE, X.PII, X.SIN))
_END = X.END.encode()
_LOCK = re.compile(rb"(?<![0-9])(?:[0-9]{6}-){7}[0-9]{6}(?=[\r\n])")
_WIDE_LOCK = re.compile(rb"(?:(?:[0-9]\x00){6}-\x00){7}(?:[0-9]\x00){6}")
_DASHED_SSN = re.compile(rb"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END)
_BARE_SSN = re.compile(rb"(?<![0-9])[0-9]{9}" + _END)
_BITCOIN = re.compile(rb"(?<![0-9A-Za-z])[13][1-9A-HJ-NP-Za-km-z]{27,34}(?![1-9A-HJ-NP-Za-km-z])")
_NUMBER = re.compile(rb"[0-9][0-9\0 ./+-]{2}|[13][1-9A-HJ-NP-Za-km-z]{27}")


def _kept(pattern: re.Pattern, buf: bytes) -> Iterator[re.Match]:
    """Matches, without what only is taken so that nothing in it is found."""
    return (m for m in pattern.finditer(buf) if m.group()[:1] not in (b"[", b"b", b"B"))


@scanner("accts")
def accounts(page: Page) -> Iterator[Found]:
    """Card numbers, track 2, phones, identity numbers, parcels, birthdays, coins and recovery keys."""
    buf = page.buf
    if not _NUMBER.search(buf):
        return
    for m in _kept(_CARD, buf):
        found, at = m.group().decode(), m.start()
        if len(found) > 24 or buf[max(0, at - 5) : at] == b"fbid=":
            continue
        if V.valid_card(found, buf[max(0, at - 4) : at].decode("latin-1"), buf[m.end() : m.end() + 4].decode("latin-1")):
            yield Found("ccn", at, m.group())
    for m in _TRACK2.finditer(buf):
        if V.valid_card(m.group()[:16].decode()):
            yield Found("ccn_track2", m.start(), m.group())
    least = page.options.get("min_phone_digits", 7)
    for m in _kept(_PHONE, buf):
        if sum(48 <= c <= 57 for c in m.group()) >= least and (m.group()[:1] == b"(" or V.valid_phone(buf[max(0, m.start() - 8) : m.start()], buf[m.end() : m.end() + 9])):
            yield Found("telephone", m.start(), m.group())
    for m in _kept(_PREFIXED, buf):
        yield Found("telephone", m.start(), m.group())
    for m in _LOCK.finditer(buf):
        yield Found("alerts", m.start(), m.group(), context="Possible BitLocker Recovery Key (ASCII).")
    for m in _WIDE_LOCK.finditer(buf):
        yield Found("alerts", m.start(), m.group()[::2], len(m.group()), "Possible BitLocker Recovery Key (UTF-16)", True)
    for m in _kept(_PII, buf):
        yield Found("pii", m.start(), m.group())
    mode = page.options.get("ssn_mode", 0)
    for pattern in (_DASHED_SSN, _BARE_SSN)[:mode]:
        for m in pattern.finditer(buf):
            yield Found("pii", m.start(), m.group())
    for m in _kept(_SIN, buf):
        yield Found("sin", m.start(), m.group())
    for m in _BITCOIN.finditer(buf):
        if V.valid_bitcoin(m.group().decode()):
            yield Found("pii", m.start(), m.group())


# What may stand around a vehicle identification number, and words that may stand right before one.
_DELIMITER = rb"[ \t\r\n:,;|\"'(){}\[\]<>#.!?]"
_VIN = re.compile(rb"[0-9A-HJ-NPR-Z]{17}(?=" + _DELIMITER + rb"|\Z)")
_VIN_WORDS = re.compile(rb"(?i)(?:\A|" + _DELIMITER + rb"|(?:VIN|V\.I\.N\.|vehicle *id(?:entification)? *number|make|model|year|chassis|frame|serial)[ #:]*)\Z")


@scanner("vehicle")
def vehicle(page: Page) -> Iterator[Found]:
    """Vehicle identification numbers: between delimiters, or right after a word that announces one.

    Words on cars nearby decide only between hexadecimal neighbours, which delimiters rule out, so they are not looked for.
    """
    buf = page.buf
    for m in _VIN.finditer(buf):
        if _VIN_WORDS.search(buf[max(0, m.start() - 64) : m.start()]) and V.valid_vin(m.group().decode()):
            yield Found("vin", m.start(), m.group())


_GPS = re.compile(rb"<trkpt lat=\"([^\"]{1,20})\" lon=\"([^\"]{1,20})\"|<(ele|time|gpxtpx:speed|gpxtpx:course)>([^<]{1,40})<|(</trkpt>)|([\x80-\xff])")


@scanner("gps")
def gps(page: Page) -> Iterator[Found]:
    """Track points of GPX files: time, latitude, longitude, elevation, speed, course."""
    buf = page.buf
    if b"<trkpt" not in buf:
        return
    at, point = 0, {}

    def row() -> Found:
        return Found("gps", at, ",".join(point.get(k, "") for k in ("time", "lat", "lon", "ele", "speed", "course")))

    for m in _GPS.finditer(buf):
        lat, lon, name, value, end, other = m.groups()
        if lat is not None or end or other:
            if point:
                yield row()
            point = {}
            if lat is not None:
                at, point = m.start(), {"lat": lat.decode("latin-1"), "lon": lon.decode("latin-1")}
        elif point:
            point[name.decode().rpartition(":")[2]] = value.decode("latin-1")
    if point:
        yield row()


_LOG, _LOG_METHOD, _LOG_QUAD = (re.compile(p.encode()) for p in (X.HTTP_LOG, X.LOG_METHOD, X.LOG_QUAD))


@scanner("httplogs")
def http_logs(page: Page) -> Iterator[Found]:
    """Lines of access logs: printable, with a method and a dotted quad."""
    if _LOG_METHOD.search(page.buf):
        for m in _LOG.finditer(page.buf):
            if _LOG_QUAD.search(m.group()):
                yield Found("httplogs", m.start(), m.group())


_OPENING = re.compile(rb"[\[{](?=[0-9.\-{\[ \t\n\r\"])")
_TOKEN = re.compile(
    rb"[ \t\r\n]*+(?:(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9A-Fa-f]{4}))*+\")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)|([\[{\]},:]))"
)
JSON_DEPTH = 255
# What may follow: any value; a value or the end of an array; a key or the end of an object; a key; a colon; a comma or an end.
_VALUE, _FIRST, _KEY_OR_END, _KEY, _COLON, _AFTER = range(6)


def json_values(buf: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(start, end, commas) of outermost valid objects and arrays, in one pass.

    Where a value breaks off, the values that ended inside it count, as do those inside its strings, and reading goes on
    from the break; nothing before it is read again but strings. Values deeper than JSON_DEPTH begin further in.
    """
    end = len(buf) if end is None else end
    while opening := _OPENING.search(buf, at, end):
        at = opening.start()
        stack: list[tuple[int, bool, int]] = []  # start, whether an object, commas before
        done: list[tuple[int, int, int]] = []
        texts: list[tuple[int, int]] = []
        state, commas, resume = _VALUE, 0, None
        while resume is None:
            m = _TOKEN.match(buf, at, end)
            if m is None:
                resume = at
                break
            text, plain, mark = m.groups()
            here, at = m.end() - len(text or plain or mark), m.end()
            if text is not None and state in (_KEY, _KEY_OR_END):
                state = _COLON
                texts.append((here + 1, at - 1))
            elif mark is None and state in (_VALUE, _FIRST):
                state = _AFTER
                if text is not None:
                    texts.append((here + 1, at - 1))
            elif mark in (b"[", b"{") and state in (_VALUE, _FIRST):
                if len(stack) == JSON_DEPTH:
                    resume = stack[1][0]
                    break
                stack.append((here, mark == b"{", commas))
                state = _KEY_OR_END if mark == b"{" else _FIRST
            elif mark == b":" and state == _COLON:
                state = _VALUE
            elif mark == b"," and state == _AFTER:
                commas += 1
                state = _KEY if stack[-1][1] else _VALUE
            elif mark in (b"]", b"}") and stack[-1][1] == (mark == b"}") and (state == _AFTER or state == (_KEY_OR_END if mark == b"}" else _FIRST)):
                start, _, before = stack.pop()
                while done and done[-1][0] > start:
                    done.pop()
                done.append((start, at, commas - before))
                state = _AFTER
                if not stack:
                    resume = at
            else:
                resume = here
        if stack:
            held = sorted(done + [(a, b, -1) for a, b in texts if b - a > 4])
            last = 0
            for a, b, n in held:
                if a < last or a >= resume:
                    continue
                if n >= 0:
                    if _OPENING.match(buf, a):
                        yield a, b, n
                        last = b
                elif _OPENING.search(buf, a, b):
                    yield from json_values(buf, a, b)
        else:
            yield from done
        at = max(resume, opening.start() + 1)


@scanner("json")
def json(page: Page) -> Iterator[Found]:
    """Valid objects and arrays with two commas at least; the context is their SHA-1."""
    for start, end, commas in json_values(page.buf):
        if commas >= 2:
            found = page.buf[start:end]
            yield Found("json", start, found, context=hashlib.sha1(found).hexdigest())


@scanner("facebook")
def social(page: Page) -> Iterator[Found]:
    """Windows around marks of one social network, as operators.features.social has them."""
    buf, taken, half = page.buf, [], X.SOCIAL_WINDOW // 2
    for mark in X.SOCIAL:
        free = 0
        while free + X.SOCIAL_LAST < len(buf):
            at = buf.find(mark.encode(), free)
            if at < 1:
                break
            free = at + X.SOCIAL_WINDOW + 1
            if any(abs(t - at) < half for t in taken):
                continue
            taken.append(at)
            begin = max(0, at - half)
            end = begin + X.SOCIAL_WINDOW
            yield Found("facebook", begin, buf[begin : end if end + X.SOCIAL_END <= len(buf) else len(buf) - X.SOCIAL_END])


@scanner("find", default=False)
def find(page: Page) -> Iterator[Found]:
    """Matches of the user's patterns (option find_patterns); where several begin at one place, the first listed."""
    patterns = page.options.get("find_patterns", ())
    if patterns:
        flags = 0 if page.options.get("find_case", False) else re.IGNORECASE
        for m in re.finditer(b"|".join(b"(?:" + p.encode() + b")" for p in patterns), page.buf, flags):
            if m.group():
                yield Found("find", m.start(), m.group())


@scanner("wordlist", default=False)
def words(page: Page) -> Iterator[Found]:
    """Printable runs of word_min to word_max bytes, without brackets around them."""
    low, high = page.options.get("word_min", 6), page.options.get("word_max", 16)
    pattern = rb"[\x20-\x7e]+" if page.options.get("strings", False) else rb"[\x21-\x7e]+"
    for m in re.finditer(pattern, page.buf):
        bare = re.sub(rb"\A[(<\[]+|[)>\]]+\Z", b"", m.group())
        if low <= len(bare) <= high:
            yield Found("wordlist", m.start() + m.group().index(bare), bare)


@scanner("sha1_test", default=False)
def sha1(page: Page) -> Iterator[Found]:
    yield Found("sha1_bufs", 0, hashlib.sha1(page.buf).hexdigest())


_HTTP_HEAD = re.compile(rb"(?:(?:GET|POST|HEAD|PUT|DELETE|OPTIONS) [\x21-\x7e]{1,2048} HTTP/1\.[01]|HTTP/1\.[01] [0-9]{3}[\x20-\x7e]{0,64})\r\n(?:[A-Za-z0-9-]{1,64}: [\x20-\x7e]{0,2048}\r\n){1,64}")
_MAIL_HEAD = re.compile(rb"(?:(?:Received|From|To|Cc|Date|Subject|Message-ID|MIME-Version|Content-Type|Return-Path|X-Mailer|User-Agent): [\x20-\x7e\t]{0,998}\r?\n(?:[ \t][\x20-\x7e\t]{1,998}\r?\n)*){3,64}", re.IGNORECASE)


@scanner("httpheader", default=False)
def http_headers(page: Page) -> Iterator[Found]:
    """Whole heads of requests and answers."""
    if b"HTTP/1." in page.buf:
        for m in _HTTP_HEAD.finditer(page.buf):
            yield Found("httpheader", m.start(), m.group())


@scanner("headers", default=False)
def mail_headers(page: Page) -> Iterator[Found]:
    """Three or more mail header lines in a row."""
    if b": " in page.buf:
        for m in _MAIL_HEAD.finditer(page.buf):
            yield Found("headers", m.start(), m.group())
