"""Histogram gradient-boosted trees, kept as flat arrays and traversed by numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees of one depth: node n has children 2n + 1 and 2n + 2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray      # go right if the value is above
    leaf: np.ndarray     # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All trees step down together, one level at a time."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        return self.base + self.leaf[trees, at - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
    l2: float = 1.0, least_rows: int = 10,
) -> Trees:
    """Boosted logistic trees; with one class or no rows the smoothed share of label 1 alone."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(
        float(np.log(share / (1 - share))), depth, np.zeros((trees, inner), np.int64),
        np.full((trees, inner), np.inf), np.zeros((trees, leaves)),
    )
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    features = x.shape[1]
    margin = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 2**level
            place = node - (width - 1)
            best = np.full(width, 1e-9)
            for f in range(features):
                key = place * BINS + binned[:, f]
                size = width * BINS
                gs = np.bincount(key, g, size).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(key, h, size).reshape(width, BINS).cumsum(axis=1)
                ns = np.bincount(key, minlength=size).reshape(width, BINS).cumsum(axis=1)
                ga, ha, na = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(ns < least_rows) | (na - ns < least_rows)] = 0
                gain = gain[:, :len(cuts[f])]
                if not gain.size:
                    continue
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                model.feature[t, width - 1 + better] = f
                model.cut[t, width - 1 + better] = cuts[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        model.leaf[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += model.leaf[t, leaf]
    return model
