"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of trees of a fixed depth. A tree is arrays of (feature, bin) by node and of values by leaf."""

    def __init__(self, trees: int = 60, depth: int = 3, bins: int = 24, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.bins, self.rate, self.ridge, self.least = trees, depth, bins, rate, ridge, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.level = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned, wide = self._binned(x), self.bins + 1
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.level = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.level)
        flat = binned + np.arange(x.shape[1]) * wide
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            slope, curve = p - y, p * (1 - p)
            feature, cut = np.zeros((1 << self.depth) - 1, int), np.full((1 << self.depth) - 1, wide)
            at = np.zeros(len(y), int)
            for level in range(self.depth):
                first = (1 << level) - 1
                for node in range(first, 2 * first + 1):
                    own = np.flatnonzero(at == node)
                    if len(own) < 4:
                        continue
                    cells = flat[own].ravel()
                    size = x.shape[1] * wide
                    g = np.bincount(cells, np.repeat(slope[own], x.shape[1]), size).reshape(-1, wide)
                    h = np.bincount(cells, np.repeat(curve[own], x.shape[1]), size).reshape(-1, wide)
                    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                    gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[node], cut[node] = divmod(best, wide - 1)
                at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - ((1 << self.depth) - 1)
            n = 1 << self.depth
            value = -self.rate * np.bincount(leaf, slope, n) / (np.bincount(leaf, curve, n) + self.ridge)
            self.nodes.append((feature, cut, value))
            raw += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        binned, raw = self._binned(x), np.full(len(x), self.level)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            raw += value[at - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-raw))
