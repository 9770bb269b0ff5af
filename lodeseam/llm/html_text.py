"""Main text of web pages: flat text blocks, judged by a decision tree on their own and their neighbours' features.

A page is read once, left to right, into text blocks between block-level tags. A block's features are its words and link
density, those of the blocks before and after it, its tag, and the marked containers around it. A decision tree, fitted
on a small labelled table that a seeded rule writes, tells which blocks are article text. Reading is linear in the page's
length, however broken the mark-up, and no page is cut.

Names mark a container as boilerplate or as an article. Classes that tell a state ("no-sidebar", "comments-open") mark
nothing, an `article` or `main` element is one whatever its classes, an element whose classes say both says nothing, and a
`header` inside an `article` or `main` belongs to it.

Defined results: a null or empty page has an empty text; a tag, comment or script that the page does not end takes the
rest of the page; a head that the page does not end stops before the first text or tag that cannot stand in a head; a `<` that opens no tag is text; character references are decoded as browsers do, those that do not
end in a semicolon included; white space, the no-break space included, becomes one space; repeated rows each get a row.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import decision_tree, value
from .common import chunks, shipped

SEED = 11
PAGES = 160

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template iframe svg textarea title head audio video".split())
#: Elements whose content is no mark-up.
RAW = frozenset("script style textarea title iframe".split())
#: Elements that may stand in a head.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
BOILER_TAGS = frozenset("nav header footer aside form button select fieldset menu dialog label legend".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
MAIN_NAMES = frozenset("article main content post entry story body articlebody".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert sidebar "
    "widget related recommended share sharing social comment comments reply replies discussion footer header nav navbar navigation menu breadcrumb breadcrumbs "
    "subscribe newsletter signup login search popup modal overlay toolbar copyright disclaimer legal masthead pagination pager tags teaser".split()
)

#: First and last words of classes that tell a state and no place.
STATE_FIRST = frozenset("no has with without is not hide show".split())
STATE_LAST = frozenset("open closed on off enabled disabled".split())

_ATTRS = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"""(?i)(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORD = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in RAW}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "in_main", "in_boiler", "page_has_main", "heading", "item")


def _side(tag: str, attrs: str) -> int:
    """1: the element holds an article, -1: it holds what surrounds articles, 0: it tells nothing."""
    if tag in BOILER_TAGS:
        return -1
    if tag in ("article", "main"):
        return 1
    if tag in ("html", "body") or "=" not in attrs:
        return 0
    main = boiler = False
    for _, found in _MARK.findall(attrs):
        for name in found.lower().strip("\"'").split():
            words = _WORD.findall(name)
            if not words or len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST):
                continue
            if BOILER_NAMES.intersection(words):
                boiler = True
            elif MAIN_NAMES.intersection(words):
                main = True
    return main - boiler


class Open:
    """The open elements, with what a block or an end tag asks of them kept up to date."""

    __slots__ = ("boiler", "hidden", "main", "marked", "of", "sides", "stack")

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.sides: list[int] = []
        self.of: dict[str, int] = {}
        self.marked: dict[str, int] = {}
        self.main = self.boiler = self.hidden = 0

    def push(self, tag: str, side: int) -> None:
        self.stack.append((tag, side))
        self.of[tag] = self.of.get(tag, 0) + 1
        self.hidden += tag in HIDDEN
        if side:
            self.sides.append(side)
            self.marked[tag] = self.marked.get(tag, 0) + 1
            self.main += side > 0
            self.boiler += side < 0

    def pop(self) -> str:
        tag, side = self.stack.pop()
        self.of[tag] -= 1
        self.hidden -= tag in HIDDEN
        if side:
            self.sides.pop()
            self.marked[tag] -= 1
            self.main -= side > 0
            self.boiler -= side < 0
        return tag

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""


class Block:
    __slots__ = ("item", "heading", "in_boiler", "in_main", "inside", "linked", "text", "words")

    def __init__(self, text: str, linked: int, around: Open):
        words = text.split()
        self.text, self.words, self.linked = " ".join(words), len(words), linked
        self.inside = around.sides[-1] if around.sides else 0
        self.in_main, self.in_boiler = around.main > 0, around.boiler > 0
        tag = around.top()
        self.heading, self.item = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit(), tag == "li"


def blocks(page: str | None) -> list[Block]:
    """All text blocks of a page, in order, without scripts, styles and other hidden elements."""
    out: list[Block] = []
    if not page:
        return out
    around = Open()
    parts: list[str] = []
    linked = links = 0
    simple = False
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            if text and not text.isspace():
                out.append(Block(text, linked, around))
        linked = 0

    def leave_head() -> None:
        if around.top() == "head":
            around.pop()

    def add(raw: str) -> None:
        nonlocal linked
        if around.hidden and not raw.isspace():
            leave_head()
        if raw and not around.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.split())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        head = _NAME.match(page, lt + 1)
        if not head:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        name = head.group().lower()
        tail = None if simple else _ATTRS.match(page, head.end())
        if tail:
            end = tail.end()
        else:
            simple = True
            end = page.find(">", head.end()) + 1
            if not end:
                break
        attrs, at = page[head.end() : end - 1], end
        if around.hidden and name not in IN_HEAD and (name[0] != "/" or name in ("/body", "/html", "/br")):
            leave_head()
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                parts.append(" ")
            marked = around.of.get(name, 0) > 0
            if name not in INLINE or marked:
                if name not in INLINE:
                    flush()
                elif parts and around.marked.get(name):
                    flush()
                if marked:
                    while around.pop() != name:
                        pass
            continue
        if name in RAW:
            end_tag = _END[name].search(page, at)
            if not end_tag:
                break
            at = page.find(">", end_tag.end()) + 1 or n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name == "a":
            links += 1
            continue
        side = 0 if name == "header" and around.main and not around.boiler else _side(name, attrs)
        if name in INLINE:
            if side == -1 and not attrs.endswith("/"):
                flush()
                around.push(name, side)
            continue
        flush()
        links = 0
        closes = CLOSES_ITSELF.get(name, ("p",))
        while around.top() in closes:
            around.pop()
        if not attrs.endswith("/"):
            around.push(name, side)
    if not around.hidden:
        flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row a block."""
    words = [b.words for b in found]
    links = [min(1.0, b.linked / b.words) for b in found]
    has_main = float(any(b.in_main for b in found))
    rows = []
    for i, b in enumerate(found):
        before, after = i - 1, i + 1 if i + 1 < len(found) else -1
        rows.append(
            (
                words[i],
                links[i],
                words[before] if i else 0,
                links[before] if i else 0.0,
                words[after] if after >= 0 else 0,
                links[after] if after >= 0 else 0.0,
                b.inside,
                b.in_main,
                b.in_boiler,
                has_main,
                b.heading,
                b.item,
            )
        )
    return np.array(rows, float).reshape(-1, len(FEATURES))


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """Small pages and the texts of their article blocks; the rule behind the labelled table."""
    rnd = random.Random(seed)
    serial = [0]

    def words(low: int, high: int) -> str:
        serial[0] += 1
        return " ".join([f"w{serial[0]}", *("".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(low, high) - 1))])

    def boiler() -> str:
        kind = rnd.randrange(9)
        links = "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(rnd.randint(2, 8)))
        name = rnd.choice(["ad", "sidebar-box", "cookie-notice", "related", "comments", "newsletter", "promo", "share"])
        return [
            f"<nav><ul>{links}</ul></nav>",
            f"<header><p>{words(2, 12)}</p></header>",
            f"<footer><p>{words(3, 20)}</p></footer>",
            f"<aside><p>{words(2, 40)}</p><p>{words(2, 30)}</p></aside>",
            f'<div class="{name}"><p>{words(2, 40)}</p></div>',
            f"<form><label>{words(1, 3)}</label><p>{words(2, 10)}</p></form>",
            f"<ul>{links}</ul>",
            f'<div id="{name}">{words(2, 25)}</div>',
            f"<div>{words(1, 5)}</div>" if not semantic else f'<section class="{name}"><h3>{words(1, 4)}</h3><p>{words(4, 30)}</p></section>',
        ][kind]

    out = []
    for _ in range(count):
        semantic = rnd.random() < 0.6
        main = [words(1, 9)] + [words(1, rnd.choice([1, 4, 30, 90])) if semantic else words(14, 90) for _ in range(rnd.randint(1, 9))]
        body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{t}</p>" + (boiler() if semantic and rnd.random() < 0.15 else "") for t in main[1:])
        opening, closing = rnd.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")]) if semantic else ("<div>", "</div>")
        page = "".join(boiler() for _ in range(rnd.randint(0, 4))) + opening + body + closing + "".join(boiler() for _ in range(rnd.randint(0, 4)))
        out.append((f"<html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>", set(main)))
    return out


def fitted_tree():
    rows, labels = [], []
    for page, main in labelled_pages():
        found = blocks(page)
        rows.append(features(found))
        labels += [b.text in main for b in found]
    return decision_tree(np.concatenate(rows), np.array(labels, float), depth=6, least=4.0)


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    kept = value(tree, features(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    sent = shipped(pages.sparkSession, fitted_tree())

    def run(batches) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(sent.value)
        for batch in chunks(batches, "html"):
            out = [main_text(t, tree) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", pages[column].alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
