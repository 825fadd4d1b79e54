"""Histogram gradient-boosted trees for a binary label, in numpy.

Values are replaced by the number of their quantile bin; a node's best cut is read off
histograms of gradients and second derivatives.  A tree is three arrays over the nodes
of a complete binary tree, so that all rows walk all levels together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosting:
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    l2: float = 1.0
    least: int = 20


@dataclass(frozen=True)
class Model:
    """Node i of a tree has children 2i + 1 (value <= cut) and 2i + 2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        inner = self.leaf.shape[1] - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cut values: each is the largest value of its bin."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))


def train(x: np.ndarray, y: np.ndarray, p: Boosting | None = None) -> Model:
    """Without rows, or with one label only, every score is that label's share (0.5 without rows)."""
    p = p or Boosting()
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**p.depth - 1, 2**p.depth
    features, cuts, outs = [], [], []
    edges = [_edges(column, p.bins) for column in x.T] if len(x) else []
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)]) if edges else None
    total = np.full(len(y), base)
    for _ in range(p.trees if len(x) and 0 < y.sum() < len(y) else 0):
        prob = 1.0 / (1.0 + np.exp(-total))
        g, h = prob - y, prob * (1 - prob)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(p.depth):
            first, count = 2**level - 1, 2**level
            at = node - first
            best = np.full(count, 1e-9)
            for f, column in enumerate(binned):
                width = len(edges[f]) + 1
                spot = at * width + column
                sums = [
                    np.bincount(spot, w, count * width).reshape(count, width).cumsum(axis=1)
                    for w in (g, h, np.ones(len(y)))
                ]
                (gl, hl, nl), (gt, ht, nt) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                gain = (
                    gl**2 / (hl + p.l2) + (gt - gl) ** 2 / (ht - hl + p.l2) - gt**2 / (ht + p.l2)
                )
                gain[(nl < p.least) | (nt - nl < p.least)] = 0
                if not gain.shape[1]:
                    continue
                where = gain.argmax(axis=1)
                value = gain[np.arange(count), where]
                better = value > best
                best[better] = value[better]
                feature[first : first + count][better] = f
                cut[first : first + count][better] = edges[f][where[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        gl = np.bincount(node - inner, g, leaves)
        leaf = -p.rate * gl / (np.bincount(node - inner, h, leaves) + p.l2)
        total += leaf[node - inner]
        features.append(feature)
        cuts.append(cut)
        outs.append(leaf)
    none = np.zeros((0, leaves))
    return Model(
        base,
        np.array(features, np.int64).reshape(-1, inner),
        np.array(cuts, float).reshape(-1, inner),
        np.array(outs) if outs else none,
    )
