"""Benchmark decontamination with a broadcast hash set of benchmark word windows.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A benchmark item gives every
window of `n` consecutive words; an item with fewer words, but not none, gives one window of all its words. A document
word inside any occurrence of any window is hit. Hashed windows are looked up first, and every hit is verified word by
word, so a hash collision never marks a word.

The set is broadcast only while the benchmark's text is at most `bound` bytes. A larger benchmark is cut into slices of
at most that size (whole items, dealt by hash); each slice is scanned in turn and the spans found are joined by row.

Defined results: a null or empty text has no words and no hits; a null item text gives no window; an item with a null id
still marks words but is not listed; repeated rows each get their own result; several items with one window are all
listed; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, shipped, texts

N = 10
#: Bytes of benchmark text whose windows are broadcast at one time: with words of six bytes some 30 MB.
BOUND = 4 << 20

_KEEP = [c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)]
#: Word characters as they are, A-Z in lower case, all others to a space.
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in _KEEP)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class Windows:
    """All windows of some items: per window length sorted hashes, a place where each stands, and the items that hold it.

    Everything but the vocabulary lies in flat arrays: a word costs 4 bytes, a window 20 and 8 for every item.
    """

    def __init__(self, items: list[tuple[int | None, bytes | None]], n: int = N):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        parts = [np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32) for _, text in items]
        lengths = np.array([len(x) for x in parts], np.int64)
        self.flat = np.concatenate([*parts, np.zeros(0, np.int32)])
        first = np.cumsum(lengths) - lengths
        self.by_length = {}
        for size in sorted(set(np.minimum(lengths[lengths > 0], n).tolist())):
            own = np.flatnonzero((lengths >= n) if size == n else (lengths == size))
            count = lengths[own] - size + 1
            item = np.repeat(own, count)
            at = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + first[item]
            for seed in range(1, 100):
                factors = np.random.default_rng(seed).integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)
                hashes = self._hash([self.flat[at + j] for j in range(size)], factors)
                order = np.argsort(hashes, kind="stable")
                again = hashes[order][1:] == hashes[order][:-1]
                a, b = at[order][1:][again], at[order][:-1][again]
                if all((self.flat[a + j] == self.flat[b + j]).all() for j in range(size)):
                    break
            new = np.concatenate([[True], ~again])
            starts = np.flatnonzero(new)
            named = np.array([-1 if items[i][0] is None else items[i][0] for i in own], np.int64)
            unnamed = np.array([items[i][0] is None for i in own], bool)
            place = np.searchsorted(own, item[order])
            self.by_length[size] = (factors, hashes[order][new], at[order][new].astype(np.int32), np.append(starts, len(order)).astype(np.int32), named[place], unnamed[place])

    @staticmethod
    def _hash(columns, factors) -> np.ndarray:
        total = 0
        for c, f in zip(columns, factors, strict=True):
            total = total + (c.astype(np.uint64) + np.uint64(1)) * f
        return total

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray | None, set[int]]:
        """Number of words, which of them are hit (None: none), and the items found."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        cover, items = None, set()
        for size, (factors, hashes, places, bounds, listed, unnamed) in self.by_length.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[: len(unknown) - size])
            if not len(at):
                continue
            h = self._hash([ids[at + j] for j in range(size)], factors)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            at, k = at[same], k[same]
            if not len(at):
                continue
            real = (self.flat[places[k][:, None] + np.arange(size)] == ids[at[:, None] + np.arange(size)]).all(axis=1)
            at, k = at[real], k[real]
            if not len(at):
                continue
            if cover is None:
                cover = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            for i in np.unique(k).tolist():
                held = slice(bounds[i], bounds[i + 1])
                items.update(listed[held][~unnamed[held]].tolist())
        return len(words), None if cover is None else np.cumsum(cover[:-1]) > 0, items


def runs(hit: np.ndarray | None) -> list[list[int]]:
    """Maximal runs of hit words as [first, end)."""
    if hit is None:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _slices(benchmark: DataFrame, bound: int) -> list[DataFrame]:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // bound) or 1
    return [benchmark] if count == 1 else [benchmark.where(F.pmod(F.xxhash64("text"), F.lit(count)) == i) for i in range(count)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = BOUND) -> DataFrame:
    """docs with a struct column `found`: n_words, n_hit, items (sorted ids) and spans (runs of hit word positions)."""
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = T.StructType([*docs.schema.fields, T.StructField("found", RESULT)])
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.list_(pa.int64())))])
    out = docs
    for step, part in enumerate(_slices(benchmark, bound)):
        sent = shipped(spark, Windows([(r.item_id, None if r.text is None else r.text.encode()) for r in part.collect()], n))

        def scan(batches, sent=sent, first=step == 0) -> Iterator[pa.RecordBatch]:
            windows = pickle.loads(sent.value)
            for batch in chunks(batches, "text"):
                before = [None] * len(batch) if first else batch.column("found").to_pylist()
                rows = []
                for text, old in zip(texts(batch, "text"), before, strict=True):
                    count, hit, items = windows.scan(text)
                    if old and old["spans"]:
                        hit = np.zeros(count, dtype=bool) if hit is None else hit
                        for a, b in old["spans"]:
                            hit[a:b] = True
                        items |= set(old["items"])
                    rows.append({"n_words": count, "n_hit": 0 if hit is None else int(hit.sum()), "items": sorted(items), "spans": runs(hit)})
                columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "found" or first]
                yield pa.RecordBatch.from_arrays([*columns[: len(docs_names)], pa.array(rows, arrow)], names=[*docs_names, "found"])

        docs_names = docs.columns
        out = out.mapInArrow(scan, schema)
    return out


def digest(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = BOUND) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, n, bound)
    names = F.array_join(F.array_sort(F.transform("found.items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[list[int]]) -> str:
    """text without the words of the runs; each run goes from its first character to its last."""
    raw = text.encode()
    marks = np.frombuffer(raw.translate(TO_WORDS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))).reshape(-1, 2)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : edges[a][0]])
        at = int(edges[b - 1][1])
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, action: str = "spans", bound: int = BOUND, drop_empty: bool = False) -> DataFrame:
    """docs without the benchmark's words (action "spans") or without the documents that hold any ("documents").

    Contaminated documents whose words are all hit are left with the characters between and around the runs, or go too
    with drop_empty. Documents without a hit always stay as they are.
    """
    if action not in ("spans", "documents"):
        raise ValueError(action)
    found = find_contamination(docs, benchmark, n, bound)
    if action == "documents":
        return found.where("found.n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
    names, schema = docs.columns, docs.schema

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            at = names.index("text")
            spans = batch.column("found").to_pylist()
            if any(s["spans"] for s in spans):
                old = batch.column(at)
                new = [without_spans(t, s["spans"]) if s["spans"] else t for t, s in zip(old.to_pylist(), spans, strict=True)]
                out = pa.RecordBatch.from_arrays([pa.array(new, old.type) if i == at else batch.column(i) for i in range(len(names))], names=names)
                yield out.filter(pa.array([not s["spans"] or bool(words_of(t.encode())) for t, s in zip(new, spans, strict=True)])) if drop_empty else out
            else:
                yield batch.select(names)

    return found.mapInArrow(cut, schema)


def items_sha256(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
o AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT o.r, o.k, o.i, g.item_id FROM o JOIN g USING (k, gram)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, sha256(string_agg(v, ',' ORDER BY v)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS v FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
