"""SetSketch of sets of 64-bit names, in numpy for many sets at once.

Every element of a set emits arrivals at times with exponential gaps, each assigned to a random register; a register keeps
the first arrival, and its value is the exponent of that time on a scale with base BASE, truncated to 0..254. Two sets'
registers merge by maximum. As a register's first arrival comes early in a large set, arrivals are only followed up to a
time by which all registers are all but surely filled; sets left with an empty register are done again for longer, so
the cut never shows in the result.
"""

from __future__ import annotations

import numpy as np

BASE = 1.2
REGISTERS = 216
ROWS = 6
BANDS = REGISTERS // ROWS
TOP = 254
#: Exponent of time 1.
OFFSET = 40

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(names: np.ndarray, sizes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of register values a set; names holds the sets' distinct elements one set after the other. No set is empty."""
    out = np.full((len(sizes), registers), np.inf)
    todo, reach = np.arange(len(sizes)), 4.0
    starts = np.cumsum(sizes) - sizes
    while len(todo):
        own = np.concatenate([names[starts[i] : starts[i] + sizes[i]] for i in todo])
        which = np.repeat(np.arange(len(todo)), sizes[todo])
        end = ((np.log(registers) + reach) / sizes[todo])[which]
        first = np.full(len(todo) * registers, np.inf)
        state, time = mix(own + _GOLD), np.zeros(len(own))
        while len(state):
            state = state + _GOLD
            z = mix(state)
            time = time - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / registers
            on = time <= end
            state, time, end, which, z = state[on], time[on], end[on], which[on], z[on]
            np.minimum.at(first, which * registers + (mix(z ^ _GOLD) % np.uint64(registers)).astype(np.int64), time)
        first = first.reshape(len(todo), registers)
        full = np.isfinite(first).all(axis=1)
        out[todo[full]] = first[full]
        todo, reach = todo[~full], reach * 2 + 4
    return np.clip(np.floor(OFFSET + 1 - np.log(out) / np.log(BASE)), 0, TOP).astype(np.uint8)


def _p(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = (BASE - 1) / BASE
    rest = 1 - np.clip(x, 0, 1) * c
    return -np.log(rest) / np.log(BASE), c / (np.log(BASE) * rest)


def slope(jaccard: np.ndarray, n: np.ndarray, k: np.ndarray, above: np.ndarray, below: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Slope of the joint log-likelihood at a similarity, for set sizes n and k and counts of registers above, below, same."""
    u, v = n / (n + k), k / (n + k)
    (pa, da), (pb, db) = _p(u - v * jaccard), _p(v - u * jaccard)
    tiny = 1e-300
    return -above * v * da / np.maximum(pa, tiny) - below * u * db / np.maximum(pb, tiny) + same * (v * da + u * db) / np.maximum(1 - pa - pb, tiny)


def at_least(threshold: float, n, k, above, below, same) -> np.ndarray:
    """Whether the likelihood, which is concave in the similarity, is largest at `threshold` or more."""
    return slope(np.float64(threshold), np.asarray(n, float), np.asarray(k, float), above, below, same) >= 0


def estimate(n: float, k: float, above: int, below: int, same: int) -> float:
    """The similarity of largest likelihood."""
    low, high = 0.0, min(n, k) / max(n, k)
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(np.float64(middle), n, k, above, below, same) >= 0 else (low, middle)
    return (low + high) / 2
