"""Gradient-boosted trees for small tables of features, trained here on bounded samples."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of shallow trees over quantile bins.  `fit` needs both classes; with one it answers that one."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[list[tuple[int, int, float]]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.cuts = []
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            # Few values are all told apart, however rare; many are cut at quantiles.
            between = (values[1:] + values[:-1]) / 2
            self.cuts.append(between if len(values) <= self.bins else np.unique(np.concatenate((between[:1], np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])))))
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees = []
        if y.min() == y.max():
            self.base = 6.0 if y.max() else -6.0
            return self
        b = self._binned(x)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            tree: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
            for at in range(2**self.depth - 1):
                mine = node == at
                if mine.sum() < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                gs, hs = g[mine].sum(), h[mine].sum()
                for k in range(b.shape[1]):
                    size = len(self.cuts[k]) + 1
                    gk = np.cumsum(np.bincount(b[mine, k], g[mine], size))[:-1]
                    hk = np.cumsum(np.bincount(b[mine, k], h[mine], size))[:-1]
                    nk = np.cumsum(np.bincount(b[mine, k], minlength=size))[:-1]
                    ok = (nk >= self.least) & (mine.sum() - nk >= self.least)
                    if not ok.any():
                        continue
                    gain = np.where(ok, gk**2 / (hk + 1) + (gs - gk) ** 2 / (hs - hk + 1) - gs**2 / (hs + 1), -1)
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), k, j)
                if best[1] >= 0:
                    tree[at] = (best[1], best[2], 0.0)
                    node[mine] = np.where(b[mine, best[1]] <= best[2], 2 * at + 1, 2 * at + 2)
            for at in range(len(tree)):
                mine = node == at
                if mine.any():
                    value = self.rate * g[mine].sum() / (h[mine].sum() + 1)
                    tree[at] = (-1, 0, float(value))
                    score[mine] += value
            self.trees.append(tree)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        if len(x) and self.trees:
            b = self._binned(x)
            for tree in self.trees:
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    feature = np.array([t[0] for t in tree])[node]
                    cut = np.array([t[1] for t in tree])[node]
                    inner = feature >= 0
                    rows = np.flatnonzero(inner)
                    right = b[rows, feature[rows]] > cut[rows]
                    node[rows] = 2 * node[rows] + 1 + right
                score += np.array([t[2] for t in tree])[node]
        return 1 / (1 + np.exp(-score))
