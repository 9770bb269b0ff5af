"""Content-defined keys of fixed-length windows: equal windows have equal keys, wherever they stand.

The key of a window of SIZE bytes is the smallest mixed hash among its GRAM-byte strings. Neighbouring windows mostly share
their smallest string, so a text falls into runs of windows with one key, about one run for every (SIZE - GRAM + 2) / 2
bytes.
"""

from __future__ import annotations

import numpy as np

from .setsketch import mix

SIZE = 100
GRAM = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(raw: np.ndarray, gram: int = GRAM, seed: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of the gram bytes from every position on; len(raw) - gram + 1 values."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, n), out=sums[1:])
    return mix((sums[gram:] - sums[: n - gram + 1]) * _powers(_INVERSE, n - gram + 1) + np.uint64(seed))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width] for every i up to len(x) - width."""
    n = len(x)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    grid[:n] = x
    grid = grid.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def keyed_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SIZE, gram: int = GRAM, most: int = 256, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key inside the pieces [starts, ends) of raw: piece, first window, windows, key, repeats, known.

    Windows never reach over a piece's end. A run has `most` windows at most. `repeats` tells that the key's string may
    occur more than once in the run, without which no two windows of a run are equal. Where a run's bytes are periodic,
    the windows that repeat the one a period before are runs of their own, and `known` to repeat. With several seeds the
    key joins the smallest strings of several orders.
    """
    none = np.zeros(0, np.int64)
    empty = (none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool))
    long = ends - starts >= size
    if len(raw) < size or not long.any():
        return empty
    width = size - gram + 1
    hashes = gram_hashes(raw, gram, seeds[0])
    least = sliding_minimum(hashes, width)
    key = least
    for seed in seeds[1:]:
        key = mix(key * _ODD + sliding_minimum(gram_hashes(raw, gram, seed), width))
    starts, counts, pieces = starts[long], (ends - starts - size + 1)[long], np.flatnonzero(long)
    valid = np.zeros(len(key) + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + counts, -1)
    edge = np.empty(len(key), bool)
    edge[0] = True
    edge[1:] = key[1:] != key[:-1]
    edge[starts] = True
    edge &= np.cumsum(valid[:-1]) > 0
    first = np.flatnonzero(edge)
    # A run ends before the next run or with its piece.
    piece = np.searchsorted(starts, first, side="right") - 1
    n = np.minimum(np.append(first[1:], len(key)), starts[piece] + counts[piece]) - first
    own = least[first]
    spots = np.flatnonzero(_among(hashes, own))
    low, high = np.searchsorted(spots, first), np.searchsorted(spots, first + n + width - 1)
    met = np.zeros(len(first), np.int64)
    for j in range(min(16, int((high - low).max(initial=0)))):
        at = low + j
        inside = at < high
        met[inside] += hashes[spots[at[inside]]] == own[inside]
    repeats = (met > 1) | (high - low > 16)
    known = np.zeros(len(first), bool)
    # Periodic runs fall into their first period, the windows that repeat it, and the rest.
    parts: list[tuple[int, int, int, bool, bool]] = []
    for i in np.flatnonzero(repeats).tolist():
        same = spots[low[i] : high[i]]
        same = same[hashes[same] == own[i]][:2]
        if len(same) < 2:
            continue
        period, a, b = int(same[1] - same[0]), int(first[i]), int(first[i] + n[i])
        held = raw[a : b + size - 1]
        off = np.flatnonzero(held[period:] != held[:-period])
        repeated = min((int(off[0]) if len(off) else len(held) - period) - size + 1, b - a - period)
        if repeated > 0:
            parts.append((i, a, period, False, len(off) > 0 and period > 1))
            parts.append((i, a + period, repeated, True, False))
            if a + period + repeated < b:
                parts.append((i, a + period + repeated, b - a - period - repeated, False, True))
    if parts:
        index, at, length, sure, again = (np.array(x) for x in zip(*parts, strict=True))
        rest = np.ones(len(first), bool)
        rest[index] = False
        piece, key_of = np.concatenate([piece[rest], piece[index]]), np.concatenate([key[first[rest]], key[first[index]]])
        first, n = np.concatenate([first[rest], at]), np.concatenate([n[rest], length])
        repeats, known = np.concatenate([repeats[rest], again]), np.concatenate([known[rest], sure])
    else:
        key_of = key[first]
    if (n[~known] > most).any():
        count = np.where(known, 1, -(-n // most))
        which = np.repeat(np.arange(len(first)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        first, n, piece, key_of, known = first[which] + step * most, np.where(known[which], n[which], np.minimum(n[which] - step * most, most)), piece[which], key_of[which], known[which]
        repeats = repeats[which] | (count[which] > 1)
    return pieces[piece], first, n, key_of, repeats, known


def _among(hashes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where a hash is one of `least`: such hashes are small, so few positions need the exact look-up."""
    small = np.flatnonzero(hashes <= least.max())
    names = np.unique(least)
    at = np.minimum(np.searchsorted(names, hashes[small]), len(names) - 1)
    out = np.zeros(len(hashes), bool)
    out[small[names[at] == hashes[small]]] = True
    return out
