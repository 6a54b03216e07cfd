"""Gradient-boosted trees for two classes, by histograms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """All trees have one depth, so a row's leaf is found by as many comparisons. Values are log odds."""

    edges: list[np.ndarray]  # of each feature: the upper bounds of its bins
    feature: np.ndarray  # tree, inner node
    cut: np.ndarray  # goes right if its bin is above
    leaf: np.ndarray  # tree, leaf
    start: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, int)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(m)]
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model = Trees(edges, np.zeros((trees, 2**depth - 1), int), np.full((trees, 2**depth - 1), BINS), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))), depth)
    bins = model.binned(x)
    flat = bins + np.arange(m) * BINS
    f = np.full(n, model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            sums = [np.bincount(at, np.repeat(w, m), width * m * BINS).reshape(width, m, BINS).cumsum(2) for w in (g, h)]
            total = [s[:, :1, -1:] for s in sums]
            gain = sum(a**2 / (b + ridge) for a, b in ((sums[0], sums[1]), (total[0] - sums[0], total[1] - sums[1]))) - total[0] ** 2 / (total[1] + ridge)
            best = gain.reshape(width, -1).argmax(1)
            split = gain.reshape(width, -1).max(1) > 1e-6
            model.feature[t, first : first + width] = np.where(split, best // BINS, 0)
            model.cut[t, first : first + width] = np.where(split, best % BINS, BINS)
            node = 2 * node + 1 + (bins[np.arange(n), model.feature[t, node]] > model.cut[t, node])
        leaf = node - (2**depth - 1)
        model.leaf[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        f += model.leaf[t, leaf]
    return model
