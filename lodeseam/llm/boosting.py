"""Small trees in numpy: a CART classifier and gradient boosting on logistic loss, both also as SQL expressions.

Rows number a few thousand at most, so every split is searched over all values of every feature. Features and splits are
tried in order and the first best wins, so a fit on the same rows always gives the same trees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Leaf = float
Node = tuple  # (feature, threshold, node where value <= threshold, node elsewhere)


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: float, l2: float) -> Node | Leaf:
    g, h = grad.sum(), hess.sum()
    best = (1e-9, None)
    if depth:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v = x[order, f]
            cg, ch = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
            ok = (v[1:] > v[:-1]) & (ch >= least) & (h - ch >= least)
            if not ok.any():
                continue
            gain = np.where(ok, cg**2 / (ch + l2) + (g - cg) ** 2 / (h - ch + l2) - g**2 / (h + l2), 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (f, float((v[i] + v[i + 1]) / 2)))
    if best[1] is None:
        return float(-g / (h + l2))
    f, t = best[1]
    low = x[:, f] <= t
    return (f, t, _grow(x[low], grad[low], hess[low], depth - 1, least, l2), _grow(x[~low], grad[~low], hess[~low], depth - 1, least, l2))


def value(node: Node | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    f, t, low, high = node
    return np.where(x[:, f] <= t, value(low, x), value(high, x))


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> list[Node | Leaf]:
    """Trees whose values add up to the log-odds of y = 1."""
    out: list = []
    raw = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        node = _scaled(_grow(x, p - y, p * (1 - p) + 1e-6, depth, least, 1.0), rate)
        out.append(node)
        raw = raw + value(node, x)
    return out


def _scaled(node: Node | Leaf, rate: float) -> Node | Leaf:
    return node * rate if isinstance(node, float) else (node[0], node[1], _scaled(node[2], rate), _scaled(node[3], rate))


def decision_tree(x: np.ndarray, y: np.ndarray, depth: int = 5, least: float = 2.0) -> Node | Leaf:
    """A tree whose leaves hold the share of y = 1, grown on squared error."""
    mean = float(y.mean())

    def shift(node: Node | Leaf) -> Node | Leaf:
        return min(1.0, max(0.0, node + mean)) if isinstance(node, float) else (node[0], node[1], shift(node[2]), shift(node[3]))

    return shift(_grow(x, mean - y.astype(float), np.ones(len(y)), depth, least, 1e-9))


def calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into log-odds: damped Newton steps on smoothed targets, slope drawn to 1."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, prior = np.column_stack([raw, np.ones(len(raw))]), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5 * ((w - prior) ** 2).sum())

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - target) + w - prior)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(w[0]), float(w[1])


def expression(node: Node | Leaf, features: list[Column]) -> Column:
    """The tree as a Column over the feature columns."""
    if isinstance(node, float):
        return F.lit(node)
    f, t, low, high = node
    return F.when(features[f] <= F.lit(t), expression(low, features)).otherwise(expression(high, features))
