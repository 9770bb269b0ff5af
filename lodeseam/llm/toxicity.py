"""Toxicity scores of whole texts by a recurrent network over overlapping windows of words.

The network (gru) learns on the driver from a bounded sample: at most SAMPLE labelled documents of either label, in the
order of a hash of their id, and at most SAMPLE_BYTES of whole texts; labels with crc32(doc_id as text) mod 5 = 0 are never
read for it. A document is toxic if one of its windows is, so it learns from each document's highest windows, chosen
anew between rounds; the first choice is by how much more often a word or character string stands in toxic documents.
A fifth of the sample is kept apart to calibrate the score, which is that of the highest window.

Scoring is one pass without a shuffle. Defined results: a null or empty text, or one without words, scores 0; repeated
rows score alike; where the sample lacks a label, all scores are 0.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import gru
from .boosting import calibrated
from .common import FOLDS, chunks, labelled, shipped, texts
from .decontaminate import words_of

SAMPLE = 1500
SAMPLE_BYTES = 16 << 20
#: Words and character strings with a vector of their own: those most tied to the label, at least Z_LEAST standard errors.
KNOWN = 4000
Z_LEAST = 3.0
ROUNDS = 4
EPOCHS = 12
RATE = 0.01
DECAY = 1e-4
SEED = 5
CACHE = 300_000


class Inputs:
    """Rows of words and character strings; row 0 is for all that have none."""

    def __init__(self, words: dict[bytes, int], strings: dict[bytes, int]):
        self.words, self.strings = words, strings

    def rows(self, word: bytes) -> tuple[int, list[int]] | None:
        """None: nothing of the word has a row."""
        own, chars = self.words.get(word, 0), [i for s in gru.strings_of(word) if (i := self.strings.get(s))]
        return (own, chars or [0]) if own or chars else None


def _joined(rows: list[tuple[int, list[int]]], own: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word inputs and, per word and dimension, the row of the character string that gave it."""
    flat = np.array([i for _, x in rows for i in x])
    starts = np.cumsum([0, *[len(x) for _, x in rows]])[:-1]
    top = np.maximum.reduceat(chars[flat], starts, axis=0)
    which = np.zeros((len(rows), chars.shape[1]), np.int64)
    lengths = np.diff(np.append(starts, len(flat)))
    owner = np.repeat(np.arange(len(rows)), lengths)
    for k in range(chars.shape[1]):
        hit = np.flatnonzero(chars[flat, k] == top[owner, k])[::-1]
        which[owner[hit], k] = flat[hit]
    return np.concatenate([own[[i for i, _ in rows]], top], axis=1).astype(np.float32), which


def _weights(up: np.ndarray, down: np.ndarray, names: list[bytes], toxic: int, clean: int) -> tuple[dict[bytes, int], np.ndarray]:
    """The features most tied to the label, with the log-odds of standing in a toxic document, shrunk by their count."""
    share = (up + down) / (toxic + clean)
    z = np.abs(up / toxic - down / clean) / np.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-12)
    likely = np.flatnonzero((z >= Z_LEAST) & (up + down > 2))
    kept = sorted(likely.tolist(), key=lambda i: (-z[i], names[i]))[:KNOWN]
    odds = (np.log((up + 0.5) / (toxic + 1)) - np.log((down + 0.5) / (clean + 1))) * (up + down) / (up + down + 3)
    return {names[i]: k + 1 for k, i in enumerate(kept)}, np.array([0.0, *odds[kept]])


class _Spelling:
    """Words of a sample as numbers, and each word's character strings as numbers, in flat arrays."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.strings: dict[bytes, int] = {}
        self.flat: list[np.ndarray] = []

    def __call__(self, text: bytes) -> np.ndarray:
        out = []
        for w in words_of(text):
            i = self.words.get(w)
            if i is None:
                i = self.words[w] = len(self.words)
                self.flat.append(np.unique([self.strings.setdefault(s, len(self.strings)) for s in gru.strings_of(w)]).astype(np.int32))
            out.append(i)
        return np.array(out, np.int32)


class Model:
    """The fitted network with its inputs and calibration."""

    def __init__(self, found: list[bytes], y: np.ndarray):
        self.empty = not 0 < y.sum() < len(y)
        if self.empty:
            return
        rng = np.random.default_rng(SEED)
        held = np.arange(len(y)) % 5 == 4
        if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
            held[:] = False
        learn = np.flatnonzero(~held)
        spell = _Spelling()
        spelt = [spell(t) for t in found]
        counts = np.zeros((2, len(spell.words)), np.int64), np.zeros((2, len(spell.strings)), np.int64)
        for i in learn.tolist():
            own_words = np.unique(spelt[i])
            if len(own_words):
                counts[0][y[i], own_words] += 1
                counts[1][y[i], np.unique(np.concatenate([spell.flat[w] for w in own_words]))] += 1
        toxic, clean = int(y[learn].sum()), int((1 - y[learn]).sum())
        word_rows, word_odds = _weights(counts[0][1], counts[0][0], list(spell.words), toxic, clean)
        string_rows, string_odds = _weights(counts[1][1], counts[1][0], list(spell.strings), toxic, clean)
        self.inputs = Inputs(word_rows, string_rows)
        spell.strings, spell.flat = {}, []
        own = rng.normal(0, 0.05, (len(word_odds), gru.WIDE)).astype(np.float32)
        chars = rng.normal(0, 0.05, (len(string_odds), gru.WIDE)).astype(np.float32)
        own[:, 0], chars[:, 0] = word_odds / 2, string_odds / 2
        own[0], chars[0] = 0, 0
        # Word 0 fills short windows, word 1 stands for all words of which nothing has a row.
        rows: list = [(0, [0]), (0, [0])]
        number = np.ones(len(spell.words), np.int64)
        for w, i in spell.words.items():
            found_rows = self.inputs.rows(w)
            if found_rows:
                number[i] = len(rows)
                rows.append(found_rows)
        views = [gru.windows(number[ids]) for ids in spelt]
        del spell, spelt
        doc = np.repeat(np.arange(len(views)), [len(v) for v in views])
        every = np.concatenate(views)
        first = np.cumsum([0, *[len(v) for v in views]])[:-1]
        p = gru.initial(rng)
        first_guess = np.maximum(own[[i for i, _ in rows], 0], _joined(rows, own, chars)[0][:, gru.WIDE])
        first_guess[0] = -9
        score = first_guess[every].max(axis=1)
        moments: dict = {}

        def update(name: str, value: np.ndarray, grad: np.ndarray, step: int) -> None:
            m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            value -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

        step = 0
        for _ in range(ROUNDS):
            order = np.lexsort([-score, doc])
            top = order[first]  # the highest window of each document
            clean = np.flatnonzero(y == 0)
            second = order[np.minimum(first + 1, np.append(first[1:], len(order)) - 1)]
            some = first + rng.integers(0, np.maximum(1, np.diff(np.append(first, len(every)))))
            chosen = np.concatenate([top[learn], second[np.intersect1d(learn, clean)], some[np.intersect1d(learn, clean)]])
            labels = y[doc[chosen]].astype(np.float32)
            weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())).astype(np.float32)
            used, local = np.unique(np.append(every[chosen].ravel(), [0, 1]), return_inverse=True)
            local = local[:-2].reshape(len(chosen), gru.WINDOW)
            part = [rows[i] for i in used]
            for _ in range(EPOCHS):
                mixed = rng.permutation(len(chosen))
                for batch in np.array_split(mixed, max(1, len(mixed) // 1024)):
                    step += 1
                    x, which = _joined(part, own, chars)
                    _, g, dx = gru.gradients(p, x, local[batch], labels[batch], weight[batch])
                    for name in p:
                        update(name, p[name], g[name].reshape(p[name].shape), step)
                    dw, dc = np.zeros_like(own), np.zeros_like(chars)
                    np.add.at(dw, [i for i, _ in part], dx[:, : gru.WIDE])
                    for k in range(gru.WIDE):
                        np.add.at(dc[:, k], which[:, k], dx[:, gru.WIDE + k])
                    dw[0], dc[0] = 0, 0
                    update("own", own, dw + DECAY * own, step)
                    update("chars", chars, dc + DECAY * chars, step)
                    own[0], chars[0] = 0, 0
            x, _ = _joined(rows, own, chars)
            table = gru.gates(p, x)
            score = np.concatenate([gru.logits(p, table, every[i : i + 8192]) for i in range(0, len(every), 8192)])
        self.p, self.own, self.chars = p, own, chars
        best = np.maximum.reduceat(score, first)
        on = held if held.any() else np.ones(len(y), bool)
        self.slope, self.intercept = calibrated(best[on].astype(float), y[on].astype(float))


class Scorer:
    """Scores texts; keeps the gate values of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = () if self.model.empty else gru.gates(self.model.p, np.zeros((2, 2 * gru.WIDE), np.float32))

    def __call__(self, found: list[bytes | None]) -> np.ndarray:
        m = self.model
        out = np.zeros(len(found))
        if m.empty:
            return out
        if len(self.number) > CACHE:
            self._clear()
        split = [words_of(t) for t in found]
        new = sorted(set().union(*split).difference(self.number))
        if new:
            known = [(w, r) for w in new if (r := m.inputs.rows(w))]
            self.number.update(dict.fromkeys(new, 1))
            if known:
                start = len(self.table[0])
                self.number.update((w, start + i) for i, (w, _) in enumerate(known))
                more = gru.gates(m.p, _joined([r for _, r in known], m.own, m.chars)[0])
                self.table = tuple(np.concatenate(pair) for pair in zip(self.table, more, strict=True))
        at = np.array([i for i, w in enumerate(split) if w], np.int64)
        if not len(at):
            return out
        get = self.number.__getitem__
        views = [gru.windows(np.array(list(map(get, split[i])), np.int64)) for i in at]
        every = np.concatenate(views)
        raw = np.concatenate([gru.logits(m.p, self.table, every[i : i + 4096]) for i in range(0, len(every), 4096)])
        best = np.maximum.reduceat(raw, np.cumsum([0, *[len(v) for v in views]])[:-1])
        out[at] = gru.sigmoid(m.slope * best.astype(float) + m.intercept)
        return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels, "toxic", SAMPLE, SAMPLE_BYTES)
    return Model([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    sent = shipped(docs.sparkSession, model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(sent.value))
        for batch in chunks(batches, "text", 1 << 20):
            ids = batch.column("doc_id").cast(pa.int64())
            score = scorer(texts(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fitted(docs, labels))
