"""Gradient-boosted trees for two classes, small enough to be trained on the driver and sent to the executors."""

from __future__ import annotations

import numpy as np


class Boost:
    """Logistic loss, histogram splits, trees of ``depth`` levels stored as complete binary trees."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        """With one class only (or no rows) the model says that class's share everywhere."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = self._codes(x)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(code, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, code)
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)

    def _grow(self, code: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(g), int)
        for at in range(size):
            here = np.flatnonzero(node == at)
            total_g, total_h = g[here].sum(), h[here].sum()
            value[at] = -self.rate * total_g / (total_h + self.ridge)
            if at >= size // 2 or len(here) < 4:
                continue
            best = 1e-6
            for f in range(code.shape[1]):
                c = code[here, f]
                left_g = np.cumsum(np.bincount(c, g[here], self.bins + 1))[:-1]
                left_h = np.cumsum(np.bincount(c, h[here], self.bins + 1))[:-1]
                gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - total_g**2 / (total_h + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], f, k
            if feature[at] >= 0:
                node[here] = 2 * at + 1 + (code[here, feature[at]] > cut[at])
        return feature, cut, value

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(code), int), np.arange(len(code))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (code[rows, f] > cut[at]))
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the second class."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        if self.trees and len(x):
            code = self._codes(x)
            for tree in self.trees:
                score += self._walk(tree, code)
        return 1 / (1 + np.exp(-score))
