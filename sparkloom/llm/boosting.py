"""Gradient-boosted trees for two classes over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    edges: list[np.ndarray]  # of each feature's bins
    feature: np.ndarray  # trees x inner nodes of complete trees of one depth
    split: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]).astype(np.int16)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out, rows = np.full(len(b), self.base), np.arange(len(b))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, s, v in zip(self.feature, self.split, self.leaf, strict=True):
            at = np.zeros(len(b), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (b[rows, f[at]] > s[at])
            out += v[at - (len(v) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, n_bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic loss; each level splits all its nodes at the best bin of the best feature."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = Trees(edges, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), n_bins + 1), np.zeros((trees, 2**depth)), float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    b = model.bins(x).astype(np.int64)
    nb, nf = n_bins + 1, x.shape[1]
    score = np.full(len(y), model.base)
    offsets = np.arange(nf) * nb
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            cell = ((at - first) * (nf * nb))[:, None] + offsets + b
            flat = cell.ravel()
            gs = np.bincount(flat, np.repeat(g, nf), n * nf * nb).reshape(n, nf, nb)
            hs = np.bincount(flat, np.repeat(h, nf), n * nf * nb).reshape(n, nf, nb)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < 1) | (ha - hl < 1)] = 0
            best = gain.reshape(n, -1).argmax(1)
            worth = gain.reshape(n, -1).max(1) > 1e-9
            model.feature[t, first : first + n] = best // nb
            model.split[t, first : first + n] = np.where(worth, best % nb, nb)
            f = model.feature[t, at]
            at = 2 * at + 1 + (b[np.arange(len(b)), f] > model.split[t, at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.leaf[t] = value
        score += value[leaf]
    return model
