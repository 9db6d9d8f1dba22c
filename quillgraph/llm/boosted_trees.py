"""Histogram gradient-boosted trees in numpy: training on a bounded sample, flat arrays for scoring.

Every tree is complete to its depth: node i has children 2i+1 and 2i+2, so one array of
features, one of thresholds and one of leaf values per tree are all that scoring needs. A
node that is not worth splitting sends every row left.
"""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    q = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> dict:
    """Logistic loss. Without rows, or with one label only, the model is a constant."""
    n_inner, n_leaf = (1 << depth) - 1, 1 << depth
    p0 = (y.sum() + 1) / (len(y) + 2)
    model = {"depth": depth, "base": float(np.log(p0 / (1 - p0))), "feature": np.zeros((0, n_inner), np.int32), "threshold": np.zeros((0, n_inner)), "value": np.zeros((0, n_leaf))}
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = bin_edges(x, bins)
    width = bins + 1
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = b + np.arange(x.shape[1]) * width
    score = np.full(len(y), model["base"])
    feature, threshold, value = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(n_inner, np.int32), np.full(n_inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (x.shape[1] * width) + flat).ravel()
            size = count * x.shape[1] * width
            hg = np.bincount(key, np.repeat(g, x.shape[1]), size).reshape(count, x.shape[1], width)
            hh = np.bincount(key, np.repeat(h, x.shape[1]), size).reshape(count, x.shape[1], width)
            gl, hl = hg.cumsum(2), hh.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2), -1.0)
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, cut = divmod(int(best[k]), width)
                if gain[k, j, cut] > 1e-9 and cut < len(edges[j]):
                    f[first + k], t[first + k] = j, edges[j][cut]
            at = x[np.arange(len(y)), f[node]] > t[node]
            node = 2 * node + 1 + at
        leaf = node - n_inner
        v = -rate * np.bincount(leaf, g, n_leaf) / (np.bincount(leaf, h, n_leaf) + l2)
        score += v[leaf]
        feature.append(f), threshold.append(t), value.append(v)
    return model | {"feature": np.array(feature), "threshold": np.array(threshold), "value": np.array(value)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row: all rows walk a tree's levels at once."""
    score = np.full(len(x), model["base"])
    rows, inner = np.arange(len(x)), (1 << model["depth"]) - 1
    for f, t, v in zip(model["feature"], model["threshold"], model["value"]):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, f[node]] > t[node])
        score += v[node - inner]
    return 1 / (1 + np.exp(-score))
