"""Gradient-boosted regression trees on binned features, for two classes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    feature: np.ndarray  # trees x nodes; -1: a leaf
    cut: np.ndarray  # values at most this go left
    value: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]))
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Newton boosting of the logistic loss; each split is the best over histograms of gradients."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    share = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    logit, size = np.full(len(y), base), 2 ** (depth + 1) - 1
    feature, cut, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = w * (p - y), w * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(size):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            gain_of = lambda a, b: a * a / (b + ridge)
            sg, sh = g[own].sum(), h[own].sum()
            value[t, node] = -rate * sg / (sh + ridge)
            if node >= size // 2:
                continue
            best = (1e-6, -1, 0)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                a = np.cumsum(np.bincount(binned[own, j], g[own], len(cuts[j]) + 1))[:-1]
                b = np.cumsum(np.bincount(binned[own, j], h[own], len(cuts[j]) + 1))[:-1]
                gain = np.where((b >= least) & (sh - b >= least), gain_of(a, b) + gain_of(sg - a, sh - b) - gain_of(sg, sh), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[t, node], cut[t, node] = best[1], cuts[best[1]][best[2]]
                at[own] = 2 * node + 1 + (binned[own, best[1]] > best[2])
        logit += value[t, at]
    return Forest(feature, cut, value, base)
