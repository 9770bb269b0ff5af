"""Burrows-Wheeler transforms of string shards, merged by iterative interleave refinement.

Each shard's suffixes are sorted on their own by as many symbols as asked (prefix doubling). The merged order of all shards
is found without sorting all suffixes again: it is kept as the list of shard numbers in suffix order, starting with the
shards one after the other. As the row of a suffix gives, with its preceding symbols, the row of the longer suffix, a
stable sort of the list by the preceding symbols refines the order by as many symbols. Symbols are taken in groups, as
many as still have at most 65536 different contents, so that a step is a radix sort of 16-bit names. A boundary between
two rows appears in the step in which their common prefix ends, so the steps also give common prefixes, and when `depth`
symbols are done the rows between two boundaries are a repeated interval: suffixes with at least `depth` symbols in common.

Only rows that lead to a whole window are followed: after h symbols these are the suffixes that begin depth - h symbols
after a window's start, one for each window.
"""

from __future__ import annotations

import numpy as np

NAMES = 1 << 16


def suffix_order(sym: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes in order of their first `depth` symbols or more, equal ones by position.

    left: symbols from each position to its string's end; what comes after the end counts as the smallest symbol.
    """
    n = len(sym)
    padded = np.concatenate([sym, np.zeros(8, sym.dtype)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    short = np.flatnonzero(left < 8)
    words[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))) - np.uint64(1))
    words[left == 0] = 0
    order = np.argsort(words)
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = words[order][1:] != words[order][:-1]
    # A suffix's rank is the first row of its block.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, at, 0))
    done = 8
    while done < depth:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        after = np.minimum(open_ + done, n - 1)
        second = np.where(left[open_] > done, rank[after] + 1, 0)
        pair = rank[open_] * np.int64(n + 2) + second
        by = np.argsort(pair)
        rows, pair = open_[by], pair[by]
        block = rank[rows]
        i = np.arange(len(rows))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], block[1:] != block[:-1]]), i, 0))
        inner = np.maximum.accumulate(np.where(np.concatenate([[True], pair[1:] != pair[:-1]]), i, 0))
        rank[rows] = block + inner - start
        done *= 2
    return np.argsort(rank * np.int64(n) + at)


class Shard:
    """The transform of some strings: suffix order, and for each row its place in its string and the symbols left."""

    def __init__(self, strings: list[bytes], depth: int):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.ends = np.cumsum(lengths) - 1
        # UTF-8 has no byte 0xFF, so with one added only terminators are 0.
        self.symbols = np.frombuffer(b"".join([s + b"\xff" for s in strings]), np.uint8) + np.uint8(1)
        at = np.arange(len(self.symbols))
        left = np.repeat(self.ends, lengths) - at
        self.order = suffix_order(self.symbols, left, depth)
        self.left = left[self.order].astype(np.int32)
        self.place = (at - np.repeat(self.ends - lengths + 1, lengths))[self.order].astype(np.int32)


def names(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """16-bit names of the strings of `width` symbols from each position on, and the width, which divides `depth`."""

    def doubled(name: np.ndarray, width: int) -> np.ndarray:
        after = np.concatenate([name[width:], np.zeros(width, name.dtype)])
        return (name.astype(np.uint32) << np.uint32(16)) | after

    def compact(wide: np.ndarray) -> np.ndarray | None:
        kinds = np.sort(wide)
        kinds = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
        return np.searchsorted(kinds, wide).astype(np.uint16) if len(kinds) <= NAMES else None

    name, width = symbols.astype(np.uint16), 1
    if depth % 5 == 0:
        padded = np.concatenate([symbols, np.zeros(5, np.uint8)]).astype(np.uint64)
        wide = np.zeros(len(symbols), np.uint64)
        for j in range(5):
            wide = (wide << np.uint64(8)) | padded[j : j + len(symbols)]
        found = compact(wide)
        if found is not None:
            name, width = found, 5
    if width == 1 and depth % 2 == 0:
        return (name << np.uint16(8)) | np.concatenate([name[1:], np.zeros(1, np.uint16)]), 2
    while depth % (2 * width) == 0:
        found = compact(doubled(name, width))
        if found is None:
            break
        name, width = found, 2 * width
    return name, width


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shards' whole windows in order of their `depth` symbols: shard, position in the shard, repeated interval.

    Windows of which no other is a copy may be missing.
    """
    if len(shards) > 65_535:
        raise ValueError("shards number 65535 at most")
    name, width = names(np.concatenate([s.symbols for s in shards]), depth)
    base = np.cumsum([0, *[len(s.symbols) for s in shards]])
    order = np.concatenate([s.order + b for s, b in zip(shards, base, strict=False)])
    left, place = np.concatenate([s.left for s in shards]), np.concatenate([s.place for s in shards])
    which = np.repeat(np.arange(len(shards)), np.diff(base)).astype(np.uint8 if len(shards) <= 256 else np.uint16)
    z = which[place >= depth]
    block = np.zeros(len(z), np.int32)
    for h in range(0, depth, width):
        # The rows in the order of each shard, and the symbols before them.
        rows = (place >= depth - h) & (left >= h)
        before = name[order[rows] - width]
        symbols = np.empty_like(before)
        symbols[np.argsort(z, kind="stable")] = before
        step = np.argsort(symbols, kind="stable")
        z, symbols, block = z[step], symbols[step], block[step]
        new = np.ones(len(z), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32) - 1
        if len(block) and block[-1] == len(block) - 1:
            none = np.zeros(0, np.int64)
            return z[:0], none, none
    whole = left >= depth
    position = np.empty(len(z), np.int64)
    position[np.argsort(z, kind="stable")] = order[whole] - base[which[whole]]
    return z, position, block
