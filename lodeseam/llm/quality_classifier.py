"""Quality by hierarchical empirical Bayes: a document's own evidence together with that of its host and path.

A document classifier (boosted trees on counts of words, symbols, cases and repetitions, fitted on a bounded sample of
labelled documents and calibrated) gives every document a probability of being good. Their means over all other documents
of its path and of its host are shrunk, the path's towards its host's and the host's towards that of all documents, with weights
that the spread between sites itself gives (method of moments): a sparse site says little beyond its parent. The log-odds
of the path's posterior mean, less those of all documents, are added to the document's own.

Sums by site are plain grouped aggregates, so a host with a third of all rows is summed up before the shuffle. Here a
document's host is its `source` and its path within it the `lang`; other columns can be named.

Defined results: a text without words scores 0; a null host or path is a site of its own; repeated rows score alike; where
the sample lacks a label, every document's own probability is 0.5, and all are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import boosted, calibrated, value
from .common import chunks, deleted, labelled, shipped, texts, written
from .quality_rules import base_counts

SAMPLE = 2000
SAMPLE_BYTES = 16 << 20
KEEP_AT = 0.5
CLOSE = 1e-4
#: Sites that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_SITES = 200_000

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"#*$%&|<>", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:"), 1):
    _CLASS[list(_chars)] = _i


def features(text: bytes | None) -> tuple[float, ...]:
    n_words, chars, symbols, dup_lines, repeated = base_counts(text)
    if not n_words:
        return (0.0,) * 11
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6)
    words = text.split()
    distinct = len(set(words))
    short = sum(len(w) == 1 for w in words)
    return (
        float(np.log2(n_words)),
        chars / n_words,
        symbols / n_words,
        classes[2] / n_words,
        classes[3] / n_words,
        classes[4] / n_words,
        classes[5] / n_words,
        distinct / n_words,
        repeated / n_words,
        dup_lines / (text.count(b"\n") + 1),
        short / n_words,
    )


class Classifier:
    """Calibrated trees; probability() of no rows' labels being known is 0.5."""

    def __init__(self, found: list[bytes], y: np.ndarray):
        self.trees = []
        if not 0 < y.sum() < len(y):
            return
        x = np.array([features(t) for t in found])
        held = np.arange(len(y)) % 4 == 3
        if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
            held[:] = False
        fit = ~held
        self.trees = boosted(x[fit], y[fit].astype(float), trees=20, depth=3)
        raw = sum(value(t, x) for t in self.trees)
        on = held if held.any() else fit
        self.slope, self.intercept = calibrated(raw[on], y[on].astype(float))

    def probability(self, found: list[bytes | None]) -> np.ndarray:
        if not self.trees:
            return np.full(len(found), 0.5)
        x = np.array([features(t) for t in found]).reshape(len(found), -1)
        p = 1 / (1 + np.exp(-(self.slope * sum(value(t, x) for t in self.trees) + self.intercept)))
        return np.where(x[:, 0:2].any(axis=1), np.clip(p, CLOSE, 1 - CLOSE), 0.0)


def with_probability(docs: DataFrame, classifier: Classifier, name: str = "__p") -> DataFrame:
    """docs with the classifier's probability as a further column."""
    sent = shipped(docs.sparkSession, classifier)
    names = docs.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.probability(texts(batch, "text")), pa.float64())], names=[*names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - CLOSE)), F.lit(CLOSE))
    return F.log(p / (1 - p))


class Prior:
    """The mean of all documents, and for how many documents a parent's mean counts: at a host, at a path."""

    def __init__(self, mean: float, host: float, path: float):
        self.mean, self.host, self.path = mean, host, path

    def host_score(self, n: Column, s: Column) -> Column:
        return (s + F.lit(self.host * self.mean)) / (n + F.lit(self.host))

    def path_score(self, n: Column, s: Column, parent: Column) -> Column:
        return (s + F.lit(self.path) * parent) / (n + F.lit(self.path))


def sites(scored: DataFrame, host: str = "source", path: str = "lang") -> tuple[DataFrame, Prior]:
    """Counts and sums of the probabilities by site (host, path, n, s, hn, hs), and the prior. scored has __p."""
    sums = scored.select(F.col(host).alias("host"), F.col(path).alias("path"), "__p").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("__p").alias("s"))
    sums = written(sums, "sites")
    hosts = sums.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k")).first()
    mean = total.s / total.n if total.n else 0.5

    def weight(rows: DataFrame, n: str, s: str, parent: Column, count: int) -> float:
        """Documents that a parent's mean counts for: mean * (1 - mean) over the variance between sites, less the chance part."""
        r = rows.agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - parent, 2)).alias("v"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("q")).first()
        within = mean * (1 - mean)
        if not r.n or count < 2 or within <= 0:
            return 1e6
        between = (r.v - (count - 1) * within) / (r.n - r.q / r.n) if r.n > r.q / r.n else 0.0
        return min(1e6, max(1.0, within / between - 1 if between > 0 else 1e6))

    kh = weight(hosts, "hn", "hs", F.lit(mean), total.k)
    named = hosts.select(F.col("host").alias("own_host"), "hn", "hs")
    both = written(sums.join(named, F.col("host").eqNullSafe(F.col("own_host"))).select("host", "path", "n", "s", "hn", "hs"), "posteriors")
    kp = weight(both, "n", "s", Prior(mean, kh, 1.0).host_score(F.col("hn"), F.col("hs")), both.count())
    deleted(sums)
    return both, Prior(mean, kh, kp)


def fitted(docs: DataFrame, labels: DataFrame) -> Classifier:
    rows = labelled(docs, labels, "quality", SAMPLE, SAMPLE_BYTES)
    return Classifier([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64))


def judged(docs: DataFrame, classifier: Classifier, host: str = "source", path: str = "lang", prefix: str = "", texts_too: bool = True) -> DataFrame:
    """docs with doc_score, host_score, path_score, posterior and kept, after the prefix (columns so named are replaced).

    The texts are read once: their probabilities are written with the documents (without the text unless texts_too).
    A document's own probability is left out of the means of its host and path.
    """
    columns = [c for c in docs.columns if texts_too or c != "text"]
    scored = written(with_probability(docs, classifier).select(*[F.col(f"`{c}`") for c in columns], "__p"), "scores")
    found, prior = sites(scored, host, path)
    found = found.select(F.col("host").alias("__host"), F.col("path").alias("__path"), *[F.col(c).alias(f"__{c}") for c in ("n", "s", "hn", "hs")])
    if found.count() <= BROADCAST_SITES:
        found = F.broadcast(found)
    joined = scored.join(found, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")), "left")
    own = F.col("__p")
    host_score = prior.host_score(F.col("__hn") - 1, F.greatest(F.col("__hs") - own, F.lit(0.0)))
    path_score = prior.path_score(F.col("__n") - 1, F.greatest(F.col("__s") - own, F.lit(0.0)), host_score)
    odds = _logit(own) + _logit(path_score) - _logit(F.lit(float(prior.mean)))
    posterior = F.when(own == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-odds)))
    made = {"doc_score": own, "host_score": host_score, "path_score": path_score, "posterior": posterior, "kept": (posterior >= KEEP_AT) if classifier.trees else F.lit(True)}
    made = {prefix + k: v for k, v in made.items()}
    return joined.select(*[F.col(f"`{c}`") for c in columns if c not in made], *[v.alias(k) for k, v in made.items()])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, source, lang, doc_score, host_score, path_score, posterior, kept."""
    return judged(docs.select("doc_id", "source", "lang", "text"), fitted(docs, labels), texts_too=False)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected documents."""
    found = judged(docs, fitted(docs, labels), prefix="__")
    return found.where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
