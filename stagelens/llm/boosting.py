"""Gradient-boosted trees for a logistic loss, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth on quantile-binned features, grown level by level from histograms of gradients."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least = trees, depth, rate, bins, penalty, least
        self.edges: list[np.ndarray] = []
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned, n = self._binned(x), x.shape[1]
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature = np.zeros(2**self.depth - 1, np.int64)
            limit = np.full(2**self.depth - 1, self.bins, np.int64)  # everything goes left
            for level in range(self.depth):
                for k in range(2**level):
                    at = 2**level - 1 + k
                    held = np.flatnonzero(node == k)
                    best = 1e-9
                    if len(held) >= 2:
                        gs, hs = g[held].sum(), h[held].sum()
                        for j in range(n):
                            gl = np.cumsum(np.bincount(binned[held, j], g[held], self.bins))
                            hl = np.cumsum(np.bincount(binned[held, j], h[held], self.bins))
                            gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                            gain[(hl < self.least / 4) | (hs - hl < self.least / 4)] = 0
                            if gain.max() > best:
                                best, feature[at], limit[at] = gain.max(), j, int(gain.argmax())
                    node[held] = 2 * k + (binned[held, feature[at]] > limit[at])
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)
            self.grown.append((feature, limit, value))
            score += value[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x):
            binned, rows = self._binned(x), np.arange(len(x))
            for feature, limit, value in self.grown:
                node = np.zeros(len(x), np.int64)
                for level in range(self.depth):
                    at = 2**level - 1 + node
                    node = 2 * node + (binned[rows, feature[at]] > limit[at])
                out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds and the probability from each on, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1][0] += last[0]
            pools[-1][1] += last[1]
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])
