"""Gradient-boosted trees over histograms of binned features, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth; node i has the children 2i + 1 and 2i + 2.

    `feature` and `cut` are (trees, inner nodes), `leaf` is (trees, 2 ** depth). A row goes right where
    its feature is above the cut.
    """

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of `x`; all rows go down a tree together."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def bin_cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature, up to bins - 1 cuts at quantiles; a value above cut i is in bin i + 1 or later."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) >= bins:
            at = np.quantile(column, np.arange(1, bins) / bins)
            middle = np.unique(middle[np.minimum(np.searchsorted(middle, at), len(middle) - 1)])
        cuts.append(middle)
    return cuts


def fit(x: np.ndarray, y: np.ndarray, trees=60, depth=4, bins=64, rate=0.15, l2=1.0, least=5) -> Forest:
    """Boosts the log loss of labels `y` of 0 and 1. Without rows, or with one label, trees stay empty."""
    share = (y.sum() + 1) / (len(y) + 2)
    inner, leaves = 2**depth - 1, 2**depth
    n, width = x.shape
    base = float(np.log(share / (1 - share)))
    forest = Forest(
        base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    )
    if not n or y.min() == y.max():
        return forest
    cuts = bin_cuts(x, bins)
    binned = np.stack([np.searchsorted(c, col) for c, col in zip(cuts, x.T)], axis=1)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * width + np.arange(width)) * bins + binned
            shape = (count, width, bins)
            sums = [
                np.bincount(slot.ravel(), np.repeat(w, width), count * width * bins).reshape(shape).cumsum(2)
                for w in (gradient, weight, np.ones(n))
            ]
            (g, h, m), (gt, ht, mt) = sums, [s[:, :, -1:] for s in sums]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(m < least) | (mt - m < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k, b in enumerate(best):
                f, at = divmod(int(b), bins)
                if gain[k, f, at] > 1e-9 and at < len(cuts[f]):
                    forest.feature[t, first + k], forest.cut[t, first + k] = f, cuts[f][at]
            feature, cut = forest.feature[t][node], forest.cut[t][node]
            node = 2 * node + 1 + (x[np.arange(n), feature] > cut)
        place = node - inner
        g, h = np.bincount(place, gradient, leaves), np.bincount(place, weight, leaves)
        forest.leaf[t] = -rate * g / (h + l2)
        margin += forest.leaf[t][place]
    return forest
