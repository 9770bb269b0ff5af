"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across (before a run of spaces, around a newline), and every
distinct word of a chunk is encoded once. All words' symbols lie in one flat array. In each round every word finds the
smallest rank among its adjacent pairs by a segmented minimum, merges the leftmost non-overlapping pairs of that rank at
once, and the array is compacted; words without a pair leave. A merged piece that could at once take part in a pair of
the same or a better rank is merged one occurrence at a time, which keeps the result that of the library's queue. Words
over LONG symbols use such a queue, as rounds that merge one pair each would be quadratic there.

Defined results: a null text counts as empty; an empty text has the begin and end ids only; characters without a piece
become their UTF-8 bytes. decode() drops the control ids and one leading space, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

SPACE = "▁"
LONG = 4096
CACHE_WORDS = 300_000
FAR = np.iinfo(np.int32).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The model's tables: symbols, pairs with rank and result, pieces as bytes."""

    def __init__(self, model: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with the identity normaliser are read")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.prefix = spec.add_dummy_prefix
        self.bos = next(i for i, p in enumerate(proto.pieces) if p.piece == "<s>")
        self.eos = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.byte = np.full(256, 0, np.uint32)
        self.surface: list[bytes] = []
        self.byte_ids: set[int] = set()
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.byte_ids.add(i)
            self.surface.append(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else proto.trainer_spec.unk_surface.encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode())
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == 2}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        symbols = list(normal) + sorted({c for p in normal for c in p} - set(normal))
        number = {s: i for i, s in enumerate(symbols)}
        self.ids = np.array([normal.get(s, -1) for s in symbols], np.int64)
        self.symbols = symbols
        levels = {s: r for r, s in enumerate(sorted({p.score for p in proto.pieces if p.type == 1}, reverse=True))}
        rank = {s: levels[proto.pieces[i].score] for s, i in normal.items()}
        pairs = []
        for s in normal:
            for i in range(1, len(s)):
                if (a := number.get(s[:i])) is not None and (b := number.get(s[i:])) is not None:
                    pairs.append((a, b, rank[s], number[s]))
        table = np.array(pairs, np.int64).reshape(-1, 4)
        self.size = len(symbols)
        keys = table[:, 0] * self.size + table[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank, self.result = keys[order], table[order, 2].astype(np.int32), table[order, 3].astype(np.int32)
        own = np.full(self.size, -1, np.int64)
        for s in normal:
            own[number[s]] = rank[s]
        #: Pieces that can at once be part of a pair of the same or a better rank.
        self.single = np.zeros(self.size, bool)
        for side in (0, 1):
            part = table[:, side]
            self.single[part[table[:, 2] <= own[part]]] = True
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        inner = any(SPACE in s.lstrip(SPACE) or "\n" in s for s in symbols)
        self.word = re.compile(r"(?s).+" if inner else r" *[^ \n]+|\n| +")
        self.pair_at = {(int(k) // self.size, int(k) % self.size): (int(r), int(x)) for k, r, x in zip(self.keys, self.rank, self.result, strict=True)}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self.rank[at], FAR), np.where(there, self.result[at], -1)


def _queue(p: Pieces, symbols: list[int]) -> list[tuple[int, int]]:
    """(symbol, first character) after all merges, for one word."""
    n = len(symbols)
    sym, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    heap: list = []

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and (x := p.pair_at.get((sym[i], sym[j]))):
            heapq.heappush(heap, (x[0], i, j, sym[i], sym[j], x[1]))

    for i in range(n - 1):
        push(i)
    gone = [False] * n
    while heap:
        _, i, j, a, b, x = heapq.heappop(heap)
        if gone[i] or gone[j] or sym[i] != a or sym[j] != b or after[i] != j:
            continue
        sym[i], gone[j], after[i] = x, True, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return [(sym[i], i) for i in range(n) if not gone[i]]


def merge_rounds(p: Pieces, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, words and first characters after all merges; sym is flat, word tells each symbol's word, ascending."""
    place = np.arange(len(sym))
    done: list[tuple] = []
    while len(sym):
        rank = np.full(len(sym), FAR, np.int32)
        result = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            r, x = p.lookup(sym[:-1], sym[1:])
            r[word[:-1] != word[1:]] = FAR
            rank[:-1], result[:-1] = r, x
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
        active = least != FAR
        if not active.all():
            out = ~active
            done.append((sym[out], word[out], place[out]))
            sym, word, place, rank, result, least = sym[active], word[active], place[active], rank[active], result[active], least[active]
            if not len(sym):
                break
        take = rank == least
        at = np.flatnonzero(take)
        # Every second one of a run of neighbours, from its left end.
        new_run = np.concatenate([[True], (np.diff(at) != 1) | (word[at][1:] != word[at][:-1])])
        run_start = at[np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))]
        at = at[(at - run_start) % 2 == 0]
        first = np.concatenate([[True], word[at][1:] != word[at][:-1]])
        slow = p.single[result[at]]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        some_slow = np.zeros(len(at), bool)
        np.logical_or.at(some_slow, lead, slow)
        at = at[first | ~some_slow[lead]]
        sym = sym.copy()
        sym[at] = result[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word, place = sym[keep], word[keep], place[keep]
    if not done:
        return sym, word, place
    sym, word, place = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(place, kind="stable")
    return sym[order], word[order], place[order]


class Tokenizer:
    """encode() and decode() with the ids of the library; `model` is the path of a SentencePiece BPE model."""

    def __init__(self, model: str | None = None):
        self.pieces = Pieces(model or default_model())
        self.cache: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        return self.pieces.word.findall(" " + text if self.pieces.prefix else text)

    def _learn(self, words: list[str]) -> None:
        """Adds the words' ids to the cache."""
        p = self.pieces
        for w in [w for w in words if len(w) > LONG]:
            chars = p.of_char[np.frombuffer(w.replace(" ", SPACE).encode("utf-32-le"), np.uint32)]
            kept = _queue(p, chars.tolist())
            self.cache[w] = self._ids(np.array([s for s, _ in kept], np.int32), np.array([i for _, i in kept]), w).tobytes()
        words = [w for w in words if len(w) <= LONG]
        if not words:
            return
        flat = "".join(words)
        codes = np.frombuffer(flat.replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym, word, place = merge_rounds(p, p.of_char[codes], np.repeat(np.arange(len(words)), lengths))
        ids = np.where(sym >= 0, p.ids[sym], -1)
        if (ids >= 0).all():
            packed, ends = ids.astype("<u4").tobytes(), np.cumsum(np.bincount(word, minlength=len(words))) * 4
            at = 0
            for w, end in zip(words, ends.tolist(), strict=True):
                self.cache[w] = packed[at:end]
                at = end
            return
        first = np.cumsum(lengths) - lengths
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        known = np.add.reduceat((ids < 0).astype(np.int64), bounds[:-1]) == 0
        packed = np.where(ids < 0, 0, ids).astype("<u4").tobytes()
        for i, w in enumerate(words):
            a, b = int(bounds[i]), int(bounds[i + 1])
            self.cache[w] = packed[a * 4 : b * 4] if known[i] else self._ids(sym[a:b], place[a:b] - first[i], w).tobytes()

    def _ids(self, sym: np.ndarray, place: np.ndarray, word: str) -> np.ndarray:
        """Ids of one word's symbols; a symbol without a piece becomes bytes."""
        out, p = [], self.pieces
        for s, i in zip(sym.tolist(), place.tolist(), strict=True):
            if s >= 0 and p.ids[s] >= 0:
                out.append(int(p.ids[s]))
            else:
                surface = p.symbols[s] if s >= 0 else word[i]
                out.extend(int(p.byte[b]) for b in surface.encode())
        return np.array(out, "<u4")

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids with begin and end id, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self._words(t or "") for t in texts]
        new = set().union(*split).difference(self.cache)
        if new:
            self._learn(sorted(new))
        cache, bos, eos = self.cache, np.uint32(self.pieces.bos).tobytes(), np.uint32(self.pieces.eos).tobytes()
        return [b"".join([bos, *map(cache.__getitem__, w), eos]) for w in split]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.packed(texts)]

    def decode(self, ids) -> str:
        p = self.pieces
        listed = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        surface = p.surface
        raw = b"".join([surface[i] for i in listed])
        first = next((i for i in listed if i not in p.control), None)
        if p.prefix and first is not None and first not in p.byte_ids and first not in p.unknown and raw.startswith(b" "):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(listed, first)

    def _decode_broken(self, listed: list[int], first: int | None) -> str:
        """As decode(); every byte that is no part of a character becomes U+FFFD."""
        p, out, run = self.pieces, [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        stripped = not p.prefix
        for i in listed:
            if i in p.byte_ids:
                run += p.surface[i]
                stripped = True
                continue
            flush()
            s = p.surface[i].decode()
            if i not in p.control and not stripped:
                s, stripped = s if i in p.unknown else s.removeprefix(" "), True
            out.append(s)
        flush()
        return "".join(out)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    model = model or default_model()

    def run(batches) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(model)
        for batch in chunks(batches, "text", 1 << 20):
            packed = tok.packed(batch.column("text").to_pylist())
            decoded = [tok.decode(np.frombuffer(x, "<u4")) for x in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, ids (array of int, with begin and end id)."""
    model = model or default_model()

    def run(batches) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(model)
        for batch in chunks(batches, "text", 1 << 20):
            ids = [x.astype(np.int32) for x in tok.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """From (doc_id, ids) back to (doc_id, text); null ids give an empty text."""
    model = model or default_model()

    def run(batches) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(model)
        for batch in batches:
            out = [tok.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
