"""Histogram gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: a row a tree, node i's children at 2i+1, 2i+2."""

    bias: float
    feature: np.ndarray  # (trees, 2 ** depth - 1) of int
    threshold: np.ndarray  # likewise; a value above goes right
    leaf: np.ndarray  # (trees, 2 ** depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row, all trees stepping down together."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.bias)))
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.empty(len(x))
        tree = np.arange(len(self.feature))[None, :]
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            total = self.bias + self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(axis=1)
            out[i : i + 4096] = 1 / (1 + np.exp(-total))
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least_weight: float = 2.0, ridge: float = 1.0) -> Trees:
    """Fits logistic loss. Each level's splits come from histograms of gradients over binned values.

    Without rows, or with one class only, the result has no trees and scores the smoothed share
    of class 1.
    """
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    none = np.zeros((0, (1 << depth) - 1))
    if n == 0 or y.min() == y.max():
        return Trees(bias, none.astype(np.int64), none, np.zeros((0, 1 << depth)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = bins + 1
    total = np.full(n, bias)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature = np.zeros((1 << depth) - 1, dtype=np.int64)
        threshold = np.full((1 << depth) - 1, np.inf)
        at = np.zeros(n, dtype=np.int64)  # place within the level
        for level in range(depth):
            first, k = (1 << level) - 1, 1 << level
            gain_best, pick = np.full(k, 1e-6), np.full((k, 2), -1)
            for f, e in enumerate(edges):
                key = at * width + binned[:, f]
                gs = np.bincount(key, g, k * width).reshape(k, width).cumsum(axis=1)
                hs = np.bincount(key, h, k * width).reshape(k, width).cumsum(axis=1)
                gl, hl = gs[:, : len(e)], hs[:, : len(e)]
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least_weight) | (ha - hl < least_weight)] = 0
                if gain.shape[1]:
                    b = gain.argmax(axis=1)
                    better = gain[np.arange(k), b] > gain_best
                    gain_best[better], pick[better, 0], pick[better, 1] = gain[np.arange(k), b][better], f, b[better]
            right = np.zeros(n, dtype=bool)
            for j in np.flatnonzero(pick[:, 0] >= 0).tolist():
                f, b = pick[j]
                feature[first + j], threshold[first + j] = f, edges[f][b]
                mine = at == j
                right[mine] = binned[mine, f] > b
            at = 2 * at + right
        gs, hs = np.bincount(at, g, 1 << depth), np.bincount(at, h, 1 << depth)
        leaf = rate * gs / (hs + ridge)
        total = total + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(bias, np.array(features), np.array(thresholds), np.array(leaves))
