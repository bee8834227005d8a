"""Gradient-boosted trees of a fixed depth on binned features, for a bounded training sample."""
from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 32


class Trees(NamedTuple):
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray  # go right when the value is above
    leaf: np.ndarray  # (trees, 2 ** depth)
    base: float


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, smooth: float = 1.0) -> Trees:
    """Logistic loss, second-order gains; ties go to the first feature and lowest threshold."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    cells = binned + np.arange(width) * BINS
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            flat = (cells + (at * width * BINS)[:, None]).ravel()
            sums = [np.bincount(flat, np.repeat(v, width), count * width * BINS).reshape(count, width, BINS) for v in (g, h)]
            left = [np.cumsum(s, 2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = sum(a ** 2 / (b + smooth) for a, b in ((left[0], left[1]), (total[0] - left[0], total[1] - left[1]))) - total[0] ** 2 / (total[1] + smooth)
            gain[(left[1] < 1) | (total[1] - left[1] < 1)] = 0
            go = np.zeros(n, np.int64)
            for node in range(count):
                best = int(gain[node].argmax())
                j, b = divmod(best, BINS)
                if gain[node].flat[best] > 1e-6 and b < len(edges[j]):
                    feature[first + node], threshold[first + node] = j, edges[j][b]
                    mine = at == node
                    go[mine] = binned[mine, j] > b
            at = 2 * at + go
        sums = [np.bincount(at, v, 2 ** depth) for v in (g, h)]
        leaf = rate * sums[0] / (sums[1] + smooth)
        score += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def scores(model: Trees, x: np.ndarray) -> np.ndarray:
    """Log-odds of each row."""
    out, rows = np.full(len(x), model.base), np.arange(len(x))
    for feature, threshold, leaf in zip(*model[:3]):
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(leaf)))):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        out += leaf[at - len(feature)]
    return out
