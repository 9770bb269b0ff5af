"""Feature extractors over a text column: one scan, no shuffle, no Python.

Each extractor gives an array of struct(recorder, offset, feature) per text; extract() joins those wanted and explodes
once. Offsets are bytes. Patterns follow the lexers' rules: left and right neighbours are look-arounds, and a text's ends
count as blanks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import validators as V
from .generator import find_all

FEATURES = "array<struct<recorder:string,offset:bigint,feature:string>>"

# The features' patterns.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{1,62}[A-Za-z0-9]@[A-Za-z0-9][A-Za-z0-9._%-]{1,250}\.[A-Za-z0-9][A-Za-z0-9-]{0,61}[A-Za-z0-9](?![A-Za-z0-9._%-])"
URL = r"(?i:https?|afp|smb)://[a-zA-Z0-9_%/+@:=&?#~.;-]{1,384}"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]|[0-9])"
QUAD = rf"(?<![0-9A-Za-z.+-]){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?![0-9.+A-Za-z_-])"
ETHER = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:])"
END = r"(?![0-9eE]|\.[0-9])"
# Number tables of page descriptions are no accounts: they are taken first, and dropped.
EATEN = r"(?i:box ?\[[0-9 -]{0,40}\])|\[ ?(?:[0-9.-]{1,12} ){3}[0-9.-]{1,12} ?\]"
CARD = (
    rf"{EATEN}|(?<![0-9A-Za-z])(?:[0-9]{{4}}[- ]){{5}}"
    rf"|(?<![0-9A-Za-z.])(?:[45][0-9]{{3}}[- ][0-9]{{4}}[- ][0-9]{{4}}[- ][0-9]{{4}}|3[0-9]{{3}}[- ][0-9]{{6}}[- ][0-9]{{5}}|[3-6][0-9]{{15,18}}|3[0-9]{{14}}){END}"
)
PHONE = (
    rf"{EATEN}|(?<![0-9A-Za-z])(?:\([0-9]{{3}}\)[ /.-]?[0-9]{{3}}[ /.-][0-9]{{4}}|[0-9]{{3}}[ /.-][0-9]{{3}}[ /.-][0-9]{{4}}|\+[0-9]{{1,3}}(?:[ /.-][0-9]{{2,3}}){{2,6}}[0-9]{{2,4}}){END}"
    r"|(?<=[ \t\n])\+[1-9][0-9]{10,18}(?![0-9])|(?<=[ \t\n])0[1-9][0-9]{9,15}(?![0-9])"
)
#: A number with its area code in brackets, with one character before it and one, or a dot and one that is no digit, after it.
BRACKETED = r"\([0-9]{3}\)[ /.-]?[0-9]{3}[ /.-][0-9]{4}"
BRACKETED_PHONE = rf"[^0-9A-Za-z]{BRACKETED}(?:[^0-9eE.]|\.[^0-9])"
PREFIXED_PHONE = rf"{EATEN}|(?i:(?<![a-z])(?:tel[.ephon]*|fax|facsimile|DSN|telex|TTD|mobile|cell):?(?:[0-9 +]+ ?[(][0-9]{{2,4}}[)] ?[0-9-]{{4,8}}|[0-9/ .+]{{7,18}}))"
PII = (
    rf"{EATEN}|(?i:fedex[^a-z]+[0-9]{{4}}[- ]?[0-9]{{4}}[- ]?[0-9]{END}|ssn:?[ \t]*[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}{END}"
    r"|dob:?[ \t]+(?:(?:19[0-9]{2}|20[01][0-9])[-/][0-9a-z]{1,9}[-/][0-9]{1,2}|[0-9]{1,2} [0-9a-z]{1,9} (?:19[0-9]{2}|20[01][0-9])|[a-z]{3,9} [0-9]{1,2}[, ]+(?:19[0-9]{2}|20[01][0-9]))"
    r"|CT[.](?:Send|Receive)[.]CMD_[A-Z0-9_]{4,25} From=[0-9]{2,12}(?: To=[0-9]{2,12})?)"
)
SIN = rf"{EATEN}|(?i:sin:?[ \t]*[0-9]{{3}}[ -]?[0-9]{{3}}[ -]?[0-9]{{3}}{END})|(?<![0-9])[0-9]{{3}}-[0-9]{{3}}-[0-9]{{3}}{END}"
TRACK2 = r"(?<![0-9A-Za-z])[4-6][0-9]{15,18}=[0-9]{2}[01][0-2]101[0-9]{13}"
RFC822 = (
    r"(?i:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),[ \t\r\n]+[0-9]{1,2}[ \t\r\n]+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[ \t\r\n]+(?:19[6-9][0-9]|20[01][0-9])[ \t\r\n]+"
    r"[0-2][0-9]:[0-5][0-9]:[0-5][0-9][ \t\r\n]+(?:[+-][0-2][0-9][0314][05]|UT|GMT|[ECMP][SD]T|[ZAMNY])"
    r"|Message-ID:(?:[ \t\n]|\r\n)?<[\x20-\x7e]{1,80}>|(?:Subject|Cookie):[ \t]?[\x20-\x7e]{1,80}|Host:[ \t]?[a-zA-Z0-9._]{1,64})"
)
LOG_METHOD = r"(?:GET|HEAD|POST|PUT|DELETE|TRACE|OPTIONS|CONNECT) "
HTTP_LOG = rf"(?<![\x20-\x7e\r])[\x20-\x7e\r]{{0,1023}}?{LOG_METHOD}[\x20-\x7e\r]{{0,1024}}(?=\n)"
LOG_QUAD = r"(?:(?<!/)[0-9]|[0-9][0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9.])"
WORD = r"[\x21-\x7e]+"
# Strings that mark pages of one social network, in the order in which they are looked for.
SOCIAL = (
    "hovercard/page", "profile_owner", "actorDescription actorNames", "navAccountName", "renderedAuthorList", "pokesText", 'id="facebook.com"',
    "OrderedFriendsListInitialData", "mobileFriends", "ShortProfiles", "bigPipe.onPageletArrive", "TimelineContentLoader",
    "Facebook is a social utility that connects", "facebook.com/profile.php", "timelineUnitContainer",
)
SOCIAL_WINDOW = 4096
#: Bytes at a buffer's end in which no mark is looked for, and that no window takes.
SOCIAL_LAST, SOCIAL_END = 50, 10


def _spans(text: Column, regex: str, needs: str | None = None) -> Column:
    return find_all(text, regex, needs)


def _tag(spans: Column, recorder: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(recorder).alias("recorder"), x["offset"].alias("offset"), x["feature"].alias("feature")))


def _left(text: Column, offset: Column, n: int) -> Column:
    """Up to n bytes before an offset, as Latin-1."""
    start = F.greatest(offset - n, F.lit(0))
    return F.decode(F.substring(text.cast("binary"), (start + 1).cast("int"), (offset - start).cast("int")), "ISO-8859-1")


def _right(text: Column, offset: Column, feature: Column, n: int) -> Column:
    return F.decode(F.substring(text.cast("binary"), (offset + F.octet_length(feature) + 1).cast("int"), F.lit(n)), "ISO-8859-1")


def emails(text: Column) -> Column:
    return F.filter(_spans(text, EMAIL, "@"), lambda x: V.valid_email(x["feature"]))


def trimmed_url(found: Column) -> Column:
    """Without a trailing &quot;; where nothing follows the host, up to its last letter."""
    plain = F.regexp_replace(found, "&quot;$", "")
    slashes = F.length(found) - F.length(F.replace(found, F.lit("/"), F.lit("")))
    return F.when(slashes == 2, F.regexp_replace(plain, "[^A-Za-z]+$", "")).otherwise(plain)


def urls(text: Column) -> Column:
    return F.transform(_spans(text, URL, "://"), lambda x: F.struct(x["offset"].alias("offset"), trimmed_url(x["feature"]).alias("feature")))


def quads(text: Column) -> Column:
    return F.filter(_spans(text, QUAD, "."), lambda x: ~V.ignored_quad_expr(_left(text, x["offset"], 8), x["feature"]))


def ethers(text: Column) -> Column:
    return F.filter(_spans(text, ETHER, ":"), lambda x: V.valid_ether(x["feature"]))


def _digits(text: Column, regex: str) -> Column:
    """Matches, without what only is taken so that nothing in it is found."""
    found = F.when(text.rlike("[0-9]{3}"), find_all(text, regex)).otherwise(F.array().cast("array<struct<offset:bigint,feature:string>>"))
    return F.filter(found, lambda x: ~x["feature"].rlike(r"^(?:\[|(?i:box))"))


def cards(text: Column) -> Column:
    sea = lambda c: c.rlike("^[0-9A-Fa-f]{4}$") & ~c.rlike("^[0-9]{4}$")
    return F.filter(
        _digits(text, CARD),
        lambda x: (F.length(x["feature"]) <= 24) & V.card_digits_ok(X.digits(x["feature"])) & ~sea(_left(text, x["offset"], 4)) & ~sea(_right(text, x["offset"], x["feature"], 4)) & ~_left(text, x["offset"], 5).endswith("fbid="),
    )


def phones(text: Column) -> Column:
    free = lambda x: x["feature"].startswith("(") | V.valid_phone_expr(_left(text, x["offset"], 8), _right(text, x["offset"], x["feature"], 9))
    plain = F.filter(_digits(text, PHONE), lambda x: free(x) & (F.length(X.digits(x["feature"])) >= 7))
    return F.concat(plain, _digits(text, PREFIXED_PHONE))


def bracketed_phones(text: Column) -> Column:
    """Of the phones those with the area code in brackets. A find takes its neighbours too, as SQL's regexp_extract_all does:
    of two finds with but one character between them only the first is given."""
    spans = find_all(F.concat(F.lit("  "), text, F.lit("  ")), BRACKETED_PHONE, "(")
    before = lambda x: F.octet_length(F.substring(x["feature"], 1, 1))
    return F.transform(spans, lambda x: F.struct((x["offset"] + before(x) - 2).alias("offset"), F.regexp_extract(x["feature"], BRACKETED, 0).alias("feature")))


def domains(text: Column) -> Column:
    """Hosts of addresses and URLs, and dotted quads."""
    after = lambda x: F.struct((x["offset"] + F.instr(x["feature"], "@")).alias("offset"), X.host_in_email(x["feature"]).alias("feature"))
    host = lambda x: F.struct((x["offset"] + F.instr(x["feature"], "://") + 2).alias("offset"), X.host_in_url(x["feature"]).alias("feature"))
    return F.concat(F.transform(emails(text), after), F.filter(F.transform(urls(text), host), lambda x: x["feature"] != ""), quads(text))


def words(text: Column, least: int = 6, most: int = 16) -> Column:
    """Printable runs of a length, brackets around them left out."""
    bare = lambda x: F.regexp_replace(x["feature"], r"^[(<\[]+|[)>\]]+$", "")
    return F.filter(F.transform(_spans(text, WORD), lambda x: F.struct((x["offset"] + F.length(F.regexp_extract(x["feature"], r"^[(<\[]*", 0))).alias("offset"), bare(x).alias("feature"))), lambda x: F.length(x["feature"]).between(least, most))


def bare_words(text: Column, least: int = 6, most: int = 16) -> Column:
    """The same words where nobody asks for their places: no offsets are worked out."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: F.regexp_replace(x, r"^[(<\[]+|[)>\]]+$", ""))
    return F.transform(F.filter(runs, lambda x: F.length(x).between(least, most)), lambda x: F.struct(F.lit(None).cast("long").alias("offset"), x.alias("feature")))


def word_rows(df: DataFrame, column: str, keep: list[str], least: int = 6, most: int = 16) -> DataFrame:
    """The words alone, one row each: no offsets are worked out."""
    rows = df.select(*keep, F.explode(F.regexp_extract_all(column, F.lit(WORD), F.lit(0))).alias("feature"))
    return rows.withColumn("feature", F.regexp_replace("feature", r"^[(<\[]+|[)>\]]+$", "")).where(F.length("feature").between(least, most))


def found(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """Matches of a user's patterns; where several begin at one place, the first listed."""
    return _spans(text, ("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))


def _places(spans: Column, mark: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(mark).alias("mark"), x["offset"].alias("at")))


def social(text: Column) -> Column:
    """Windows of SOCIAL_WINDOW bytes around marks: one mark after the other, each SOCIAL_WINDOW apart, none within half a
    window of one found before. A mark at a text's first byte ends the search for it."""
    raw = text.cast("binary")
    size = F.length(raw).cast("long")
    half = F.lit(SOCIAL_WINDOW // 2).cast("long")
    hits = F.flatten(F.array(*[_places(_spans(text, re.escape(m), m), i) for i, m in enumerate(SOCIAL)]))
    start = F.struct(F.lit(-1).alias("mark"), F.lit(0).cast("long").alias("free"), F.array().cast("array<bigint>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        free = F.when(a["mark"] == x["mark"], a["free"]).otherwise(F.lit(0).cast("long"))
        over = (x["at"] < free) | (free + SOCIAL_LAST >= size) | (x["at"] < 1)
        used = F.exists(a["taken"], lambda t: F.abs(t - x["at"]) < half)
        next_free = F.when(x["at"] < 1, size).when(over, free).otherwise(x["at"] + SOCIAL_WINDOW + 1)
        taken = F.when(over | used, a["taken"]).otherwise(F.concat(a["taken"], F.array(x["at"])))
        return F.struct(x["mark"].alias("mark"), next_free.alias("free"), taken.alias("taken"))

    def window(at: Column) -> Column:
        begin = F.greatest(at - half, F.lit(0).cast("long"))
        end = F.when(begin + SOCIAL_WINDOW + SOCIAL_END > size, size - SOCIAL_END).otherwise(begin + SOCIAL_WINDOW)
        return F.struct(begin.alias("offset"), F.decode(F.substring(raw, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), "UTF-8").alias("feature"))

    found = F.transform(F.aggregate(hits, start, step, lambda a: a["taken"]), window)
    return F.when(text.rlike("|".join(map(re.escape, SOCIAL))), found).otherwise(F.array().cast("array<struct<offset:bigint,feature:string>>"))


def simple(regex: str, needs: str | None = None) -> Callable[[Column], Column]:
    return lambda text: _spans(text, regex, needs)


EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "email": emails,
    "url": urls,
    "domain": domains,
    "ether": ethers,
    "ccn": cards,
    "telephone": phones,
    "ccn_track2": lambda t: F.filter(_spans(t, TRACK2, "="), lambda x: V.card_digits_ok(F.substring(x["feature"], 1, 16))),
    "pii": lambda t: _digits(t, PII),
    "sin": lambda t: _digits(t, SIN),
    "rfc822": simple(RFC822, ":"),
    "httplogs": lambda t: F.when(t.rlike(LOG_METHOD), F.filter(_spans(t, HTTP_LOG), lambda x: x["feature"].rlike(LOG_QUAD))).otherwise(F.array().cast("array<struct<offset:bigint,feature:string>>")),
    "facebook": social,
    "wordlist": words,
}


def extract(df: DataFrame, column: str, recorders: list[str], keep: list[str], patterns: list[str] | None = None, using: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row for each feature: the columns of `keep`, recorder, offset, feature. `using` gives recorders other extractors."""
    text = F.col(column)
    parts = [_tag((EXTRACTORS | (using or {}))[r](text), r) for r in recorders]
    if patterns:
        parts.append(_tag(found(text, patterns), "find"))
    return df.where(text.isNotNull()).select(*keep, F.inline(parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))))


def with_context(features: DataFrame, texts: DataFrame, keys: list[str], column: str, window: int = 16) -> DataFrame:
    """features with the bytes around them, `window` to either side, as Latin-1."""
    joined = features.join(texts.select(*keys, F.col(column).alias("__text")), keys)
    raw = F.col("__text").cast("binary")
    start = F.greatest(F.col("offset") - window, F.lit(0))
    length = F.col("offset") - start + F.octet_length("feature") + window
    return joined.withColumn("context", F.decode(F.substring(raw, (start + 1).cast("int"), length.cast("int")), "ISO-8859-1")).drop("__text")
