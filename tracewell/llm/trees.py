"""Gradient-boosted regression trees for two classes, on binned features, in NumPy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Logistic boosting: each tree fits the gradient of the loss so far, leaves take a Newton step."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: float = 5.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.least, self.ridge = rounds, depth, rate, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.cuts: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """``x``: rows by features, ``y``: 0 or 1."""
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """A full tree of ``depth`` levels: feature and cut of each inner node, value of each leaf."""
        n, m = binned.shape
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)  # place among the nodes of the level
        for level in range(self.depth):
            width = 1 << level
            best, pick, where = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, np.int64)
            for j in range(m):
                key = at * BINS + binned[:, j]
                gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                k = gain[:, :-1].argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], pick[better], where[better] = top[better], j, k[better]
            right = np.zeros(n, bool)
            for node in range(width):
                if pick[node] >= 0 and where[node] < len(self.cuts[pick[node]]):
                    feature[width - 1 + node], cut[width - 1 + node] = pick[node], self.cuts[pick[node]][where[node]]
                    own = at == node
                    right[own] = binned[own, pick[node]] > where[node]
            at = at * 2 + right
        leaves = 1 << self.depth
        value = -self.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + self.ridge)
        return (feature, cut, value), at

    def decide(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            f += value[at - len(feature)]
        return f
