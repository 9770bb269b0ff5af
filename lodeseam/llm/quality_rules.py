"""Quality rules: base counts on words and lines, and a verdict from tokeniser fertility.

Every text is tokenised with a public SentencePiece vocabulary. Measures: characters per token, share of byte-fallback
tokens (newlines apart), and token entropy (Shannon entropy of the text's tokens over log2 of their number). Rejection
bands are kept per language, script and length (power of two of the tokens, as entropy falls with length): for each
measure the median and the spread (distance between the quartiles) over all documents of the group, and a text is
rejected if a measure lies more than WIDTH spreads, and more than FLOOR, beyond the median on its bad side. A group of
under FEW documents takes the bands of its length in all languages; where that is as small, nothing is rejected.

One small row a document is written; the bands are one row a group, of every group that is large enough, made from counts
of the measures on a fixed grid, so that they are the same however the rows are dealt. They are broadcast up to BROADCAST_GROUPS rows, and joined by shuffle beyond it. A measure counts from MIN_TOKENS tokens up; the base rules hold for every text.

Defined results: a null or empty text has no words, hence fails the base rules; a null language is a group of its own;
repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, texts, written
from .sentencepieces import Tokenizer, default_model

MIN_WORDS = 10
REPEAT_PERCENT = 20
SHINGLE = 5
WIDTH = 5.0
#: A measure must also lie this far beyond the median, so that a narrow group does not reject what is almost usual.
FLOOR = {"chars_per_token": 0.15, "fallback_share": 0.02, "entropy": 0.1}
MIN_TOKENS = 64
FEW = 100
#: Steps of the grid on which quartiles are found: parts of a unit, and the highest step.
GRID = 1024
TOP = 64 * GRID
#: Groups whose bands are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 200_000

SYMBOLS = b"#*$%&|<>"
_MARK = bytes(1 if c in SYMBOLS else 0 for c in range(256))

SCHEMA = (
    "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, fallback_share double, entropy double"
)


def repeated_words(words: list[bytes], size: int = SHINGLE) -> int:
    """Words inside windows of `size` words that occur twice or more in the text, the first included."""
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if n <= size or len(number) == n:
        return 0
    if (len(number) + 1) ** size < 1 << 64:
        name = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            name = name * np.uint64(len(number) + 1) + ids[j : n - size + 1 + j]
    else:  # a window's name is the pair of the names of all but its last word and of that word
        name = ids
        for j in range(1, size):
            name = np.unique(name[: n - j] * np.uint64(n + 1) + ids[j:], return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(name), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    cover[: len(name)] += twice
    cover[size:] -= twice
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    joined = b"".join(words)
    raw = np.frombuffer(joined, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, joined.translate(_MARK).count(1), len(lines) - len(set(lines)), repeated_words(words)


def entropy(ids: np.ndarray) -> float:
    """Entropy of the ids over its largest possible value; 1 for fewer than two ids."""
    if len(ids) < 2:
        return 1.0
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    return float(-(p * np.log2(p)).sum() / math.log2(len(ids)))


def script_of(text: bytes) -> str:
    """The script of most letters, told by the lead bytes of UTF-8: latin, greek_cyrillic, other, or none."""
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    latin = counts[0x41:0x5B].sum() + counts[0x61:0x7B].sum() + counts[0xC3:0xCA].sum()
    east = counts[0xCD:0xD4].sum()
    other = counts[0xD4:0xF5].sum()
    most = max(latin, east, other)
    return "none" if not most else "latin" if latin == most else "greek_cyrillic" if east == most else "other"


def measures(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document its language, the base counts and the tokeniser measures."""
    model = model or default_model()
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")

    def run(batches) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(model)
        fallback = np.zeros(len(tok.pieces.surface), bool)
        fallback[list(tok.pieces.byte_ids - {int(tok.pieces.byte[10])})] = True
        for batch in chunks(batches, "text", 1 << 20):
            rows = []
            for text, packed in zip(texts(batch, "text"), tok.packed(batch.column("text").to_pylist()), strict=True):
                ids = np.frombuffer(packed, "<u4")[1:-1].astype(np.int64)
                counts = base_counts(text)
                n = max(1, len(ids))
                rows.append((script_of(text or b""), *counts, len(ids), counts[1] / n, int(fallback[ids].sum()) / n, entropy(ids)))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *[pa.int64()] * 6, *[pa.float64()] * 3], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang"), *made], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(run, SCHEMA)


def judged(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document the counts, the measures, base_failed, band_failed and kept."""
    rows = written(measures(docs, model), "measures").withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    usable = rows.where((F.col("n_tokens") >= MIN_TOKENS) & ~base_failed)
    steps = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.least(F.round(F.col(m) * GRID), F.lit(TOP)).cast("int").alias("step")) for m in FLOOR]))
    counts = usable.select("lang", "script", "size", steps.alias("x")).groupBy("lang", "script", "size", "x.m", "x.step").agg(F.count("*").alias("k"))
    counts = written(counts, "grid")

    def bands(prefix: str, *keys: str) -> DataFrame:
        """Per group the quartiles of each measure: the first step that a quarter of the documents does not exceed, and so on."""
        by_step = counts.groupBy(*keys, "m", "step").agg(F.sum("k").alias("k"))
        group = Window.partitionBy(*keys, "m")
        upto = by_step.select(*keys, "m", "step", F.sum("k").over(group.orderBy("step")).alias("upto"), F.sum("k").over(group).alias("n")).where(F.col("n") >= FEW)
        quartiles = [F.min(F.when(F.col("upto") * 4 >= F.col("n") * q, F.col("step"))) / GRID for q in (1, 2, 3)]
        rows = upto.groupBy(*keys, "m").agg(F.array(*quartiles).alias("q"))
        groups = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("m") == m, F.col("q"))).alias(f"{prefix}{m}") for m in FLOOR])
        groups = written(groups, f"{prefix}bands")
        return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups

    joined = rows.join(bands("own_", "lang", "script", "size"), ["lang", "script", "size"], "left").join(bands("all_", "size"), ["size"], "left")
    fails = F.lit(False)
    for m, floor in FLOOR.items():
        q = F.coalesce(f"own_{m}", f"all_{m}")
        off = F.abs(F.col(m) - q[1]) if m == "chars_per_token" else F.col(m) - q[1] if m == "fallback_share" else q[1] - F.col(m)
        fails = fails | F.coalesce(off > F.greatest(F.lit(WIDTH) * (q[2] - q[0]), F.lit(floor)), F.lit(False))
    band_failed = (F.col("n_tokens") >= MIN_TOKENS) & fails
    return joined.select(*[c for c in rows.columns if c != "size"], base_failed.alias("base_failed"), band_failed.alias("band_failed"), (~base_failed & ~band_failed).alias("kept"))


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    return judged(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "script", "n_tokens", "chars_per_token", "fallback_share", "entropy"
    )


def keep(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs without the documents rejected, by doc_id; rows that share a doc_id go together if any of them is rejected."""
    bad = judged(docs, model).where(~F.col("kept")).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad")), "left_anti")
