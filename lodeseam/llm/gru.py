"""A small bidirectional gated recurrent network with attention pooling, forward and backward in numpy.

A word's input joins its own vector and the element-wise largest of the vectors of its character strings (three to five
bytes, the word's ends marked). Two gated recurrent layers read a window in both directions, attention pools their states,
and a linear unit gives the log-odds that the window is toxic.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32
STRIDE = 16
WIDE = 6
HIDDEN = 8


def strings_of(word: bytes) -> list[bytes]:
    marked = b"\x02" + word + b"\x03"
    return [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]


def windows(ids: np.ndarray) -> np.ndarray:
    """All windows of WINDOW words, STRIDE apart, the last one ending with the text; short ones are filled with 0."""
    n = len(ids)
    if n <= WINDOW:
        out = np.zeros((1, WINDOW), ids.dtype)
        out[0, :n] = ids
        return out
    starts = np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)
    return ids[starts[:, None] + np.arange(WINDOW)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = 2 * WIDE, HIDDEN
    p = {}
    for side in "fb":
        p[f"w{side}"] = rng.normal(0, d**-0.5, (d, 3 * h))
        p[f"u{side}"] = rng.normal(0, h**-0.5, (h, 3 * h))
        p[f"c{side}"] = np.zeros(3 * h)
    p["aw"], p["ab"], p["av"] = rng.normal(0, (2 * h) ** -0.5, (2 * h, h)), np.zeros(h), rng.normal(0, h**-0.5, h)
    p["ow"], p["ob"] = rng.normal(0, (2 * h) ** -0.5, 2 * h), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _layer(gates: list[np.ndarray], u: np.ndarray, mask: np.ndarray, keep: bool):
    """States after every step from the inputs' gate values; padding leaves the state as it is."""
    h = HIDDEN
    state = np.zeros((mask.shape[0], h), np.float32)
    states, saved = [], []
    for t, g in enumerate(gates):
        rz = sigmoid(g[:, : 2 * h] + state @ u[:, : 2 * h])
        r, z = rz[:, :h], rz[:, h:]
        inner = state @ u[:, 2 * h :]
        n = np.tanh(g[:, 2 * h :] + r * inner)
        m = mask[:, t : t + 1]
        new = state + m * ((1 - z) * (n - state))
        if keep:
            saved.append((state, r, z, n, inner))
        state = new
        states.append(state)
    return states, saved


def _back(grads: np.ndarray, saved: list, u: np.ndarray, mask: np.ndarray):
    """Gradients of the gates' inputs and of u, from those of the states."""
    h = HIDDEN
    du, carry, out = np.zeros_like(u), np.zeros_like(saved[0][0]), [None] * len(saved)
    for t in range(len(saved) - 1, -1, -1):
        state, r, z, n, inner = saved[t]
        total, m = grads[t] + carry, mask[:, t : t + 1]
        moved = total * m
        dn = moved * (1 - z) * (1 - n * n)
        dz = -moved * (n - state) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        dg = np.concatenate([dr, dz, dn], axis=1)
        du[:, : 2 * h] += state.T @ dg[:, : 2 * h]
        du[:, 2 * h :] += state.T @ (dn * r)
        carry = total - moved * (1 - z) + dg[:, : 2 * h] @ u[:, : 2 * h].T + (dn * r) @ u[:, 2 * h :].T
        out[t] = dg
    return out, du


def _pool(p: dict, states: np.ndarray, mask: np.ndarray):
    """states: (steps, windows, 2 h)."""
    q = np.tanh(states @ p["aw"] + p["ab"])
    e = q @ p["av"]
    e = np.where(mask.T > 0, e, -1e9)
    a = np.exp(e - e.max(axis=0))
    a *= mask.T > 0
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return q, a, pooled, pooled @ p["ow"] + p["ob"][0]


def logits(p: dict, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Log-odds of windows; table holds every word's gate values for both directions."""
    mask = (ids > 0).astype(np.float32)
    front, _ = _layer([table[0][ids[:, t]] for t in range(WINDOW)], p["uf"], mask, False)
    back, _ = _layer([table[1][ids[:, t]] for t in range(WINDOW - 1, -1, -1)], p["ub"], mask[:, ::-1], False)
    return _pool(p, np.concatenate([np.stack(front), np.stack(back[::-1])], axis=2), mask)[3]


def gates(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x @ p["wf"] + p["cf"]).astype(np.float32), (x @ p["wb"] + p["cb"]).astype(np.float32)


def gradients(p: dict, x: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Loss, gradients of the parameters, and of the word inputs x."""
    mask = (ids > 0).astype(np.float32)
    tf, tb = gates(p, x)
    front, sf = _layer([tf[ids[:, t]] for t in range(WINDOW)], p["uf"], mask, True)
    back, sb = _layer([tb[ids[:, t]] for t in range(WINDOW - 1, -1, -1)], p["ub"], mask[:, ::-1], True)
    states = np.concatenate([np.stack(front), np.stack(back[::-1])], axis=2)
    q, a, pooled, raw = _pool(p, states, mask)
    prob = sigmoid(raw)
    loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / weight.sum())
    d = (weight * (prob - y) / weight.sum()).astype(np.float32)
    g = {"ow": pooled.T @ d, "ob": np.array([d.sum()])}
    dpool = d[:, None] * p["ow"]
    dstates = a[:, :, None] * dpool[None]
    da = np.einsum("tnh,nh->tn", states, dpool)
    de = a * (da - (a * da).sum(axis=0))
    dq = de[:, :, None] * p["av"] * (1 - q * q)
    g["av"] = np.einsum("tn,tnk->k", de, q)
    g["aw"], g["ab"] = np.einsum("tnh,tnk->hk", states, dq), dq.sum(axis=(0, 1))
    dstates = dstates + dq @ p["aw"].T
    dgf, g["uf"] = _back(dstates[:, :, :HIDDEN], sf, p["uf"], mask)
    dgb, g["ub"] = _back(dstates[::-1, :, HIDDEN:], sb, p["ub"], mask[:, ::-1])
    dx = np.zeros_like(x)
    for side, dg, order in (("f", dgf, range(WINDOW)), ("b", dgb, range(WINDOW - 1, -1, -1))):
        total = np.zeros((len(x), 3 * HIDDEN), np.float32)
        for t, part in zip(order, dg, strict=True):
            np.add.at(total, ids[:, t], part)
        total[0] = 0
        g[f"w{side}"], g[f"c{side}"] = x.T @ total, total.sum(axis=0)
        dx += total @ p[f"w{side}"].T
    return loss, g, dx
