"""Gradient-boosted trees over histograms, flattened into arrays.

Features are cut into at most 64 bins by quantiles; trees grow level by level
from gradient histograms, with logistic loss. All trees of a model have one
depth and lie in arrays indexed by tree and node, so a batch of rows walks a
tree with one gather per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    feature: np.ndarray  # tree x inner node
    cut: np.ndarray  # go right if the value is larger
    leaf: np.ndarray  # tree x leaf
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, smooth: float = 2.0, least: int = 5) -> Forest:
    """A model of P(y = 1). One class only, or no rows, gives the constant of the data (one half without rows)."""
    n, f = x.shape
    p = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Forest(feature[:0], cut[:0], leaf[:0], base if n else 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(width)
            for j in range(f):
                cell = local * BINS + binned[:, j]
                g, h, c = (np.bincount(cell, w, width * BINS).reshape(width, BINS) for w in (grad, hess, None))
                gl, hl, cl = g.cumsum(1), h.cumsum(1), c.cumsum(1)
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                gain[(cl < least) | (ct - cl < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                at = gain.argmax(1)
                up = gain[np.arange(width), at]
                win = up > best + 1e-9
                best[win] = up[win]
                feature[t, first : first + width][win] = j
                if len(cuts[j]):
                    cut[t, first : first + width][win] = cuts[j][at.clip(max=len(cuts[j]) - 1)][win]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + smooth)
        score += leaf[t][at]
    return Forest(feature, cut, leaf, base)
