"""Gradient-boosted trees on small integer features: second-order boosting for the logistic loss, in numpy."""

from __future__ import annotations

import numpy as np

from weftgraph.functions.shipping import by_value


def _merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of their labels and how often each stands."""
    packed = np.ascontiguousarray(x.astype(np.int16)).view(np.dtype((np.void, 2 * x.shape[1]))).ravel()
    _, first, back, weight = np.unique(packed, return_index=True, return_inverse=True, return_counts=True)
    return x[first], np.bincount(back.ravel(), y, len(first)), weight.astype(float)


class BoostedTrees:
    """Trees of one fixed depth, each a full binary tree of (feature, threshold) and leaf values."""

    def __init__(self, trees: int = 64, depth: int = 5, rate: float = 0.3, penalty: float = 1.0):
        self.n_trees, self.depth, self.rate, self.penalty = trees, depth, rate, penalty
        self.feature = np.zeros((0, 0), np.int64)
        self.threshold = np.zeros((0, 0), np.int64)
        self.leaf = np.zeros((0, 0))
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: rows of non-negative integers; y: 0 or 1. Equal rows are fitted as one with its weight."""
        bins = int(x.max()) + 1
        x, y, weight = _merged(x, y)
        n, width = x.shape
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.n_trees, inner), np.int64)
        self.threshold = np.full((self.n_trees, inner), bins, np.int64)
        self.leaf = np.zeros((self.n_trees, inner + 1))
        share = min(max(y.sum() / weight.sum(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * p - y, weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                best = np.zeros(count)
                for f in range(width):
                    slot = (node - first) * bins + x[:, f]
                    gs = np.bincount(slot, g, count * bins).reshape(count, bins).cumsum(1)
                    hs = np.bincount(slot, h, count * bins).reshape(count, bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    better = np.flatnonzero(top > best + 1e-9)
                    best[better] = top[better]
                    self.feature[t, first + better] = f
                    self.threshold[t, first + better] = at[better]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.threshold[t, node])
            place = node - inner
            gl, hl = np.bincount(place, g, inner + 1), np.bincount(place, h, inner + 1)
            self.leaf[t] = -self.rate * gl / (hl + self.penalty)
            margin += self.leaf[t, place]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            out += self.leaf[t, node - inner]
        return out


by_value(__name__)
