"""Small models fitted on the driver from bounded samples: boosted trees and isotonic calibration."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Trees:
    """Gradient-boosted regression trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: int = 10) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        self.trees: list[list[tuple[int, float, float]]] = []  # (feature or -1, cut, value) in heap order
        score = np.full(n, self.start)
        for _ in range(self.rounds):
            p = sigmoid(score)
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            self._grow(tree, 0, np.arange(n), binned, grad, hess, 0)
            self.trees.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, tree: list, at: int, rows: np.ndarray, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        tree[at] = (-1, 0.0, float(-self.rate * g / (h + self.ridge)))
        if level == self.depth or len(rows) < 2 * self.least:
            return
        best = (1e-6, -1, -1)
        for j, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            b = binned[rows, j]
            size = len(cuts) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
            gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        _, j, k = best
        if j >= 0:
            tree[at] = (j, float(self.cuts[j][k]), 0.0)
            left = binned[rows, j] <= k
            self._grow(tree, 2 * at + 1, rows[left], binned, grad, hess, level + 1)
            self._grow(tree, 2 * at + 2, rows[~left], binned, grad, hess, level + 1)

    @staticmethod
    def _walk(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(v) for v in zip(*tree))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            j = at[rows]
            at[rows] = 2 * j + 1 + (x[rows, feature[j]] > cut[j])
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self._walk(tree, x)
        return out


class Isotonic:
    """Non-decreasing least-squares fit by pooling adjacent violators, linear between its knots."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        pools: list[list[float]] = []  # mean, weight, sum of scores
        for a, b in zip(s[order], y[order]):
            pools.append([float(b), 1.0, float(a)])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                m, w, t = pools.pop()
                last = pools[-1]
                last[0] = (last[0] * last[1] + m * w) / (last[1] + w)
                last[1] += w
                last[2] += t
        # half a row of each outcome keeps the ends off 0 and 1
        self.x = np.array([t / w for _, w, t in pools])
        self.y = np.array([(m * w + 0.5 * 0.5) / (w + 0.5) for m, w, _ in pools])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if not len(self.x):
            return sigmoid(s)
        # a slight slope keeps the order of scores within a pool
        return np.clip(0.999 * np.interp(s, self.x, self.y) + 0.001 * sigmoid(s), 0.0, 1.0)
