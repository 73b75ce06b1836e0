"""Small gradient-boosted trees: fitted with numpy on a bounded training set, applied by numpy or as a Column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple | float


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 8) -> list[Tree]:
    """Trees for the log-odds of y (0 or 1), by Newton steps on the logistic loss.  A tree is a leaf value or (feature, threshold, low, high)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        mids = (values[1:] + values[:-1]) / 2
        cuts.append(mids if len(mids) <= bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 2)[1:-1])))
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    out: list[Tree] = [prior]
    score = np.full(len(y), prior)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Tree:
        value = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if left == 0 or len(rows) < 2 * least:
            return value
        gt, ht = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        for f, thresholds in enumerate(cuts):
            for t in thresholds:
                low = x[rows, f] <= t
                n = int(low.sum())
                if n < least or len(rows) - n < least:
                    continue
                gl, hl = g[rows][low].sum(), h[rows][low].sum()
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                if gain > best[0]:
                    best = (gain, f, float(t))
        if best[1] is None:
            return value
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        out.append(tree)
        score = score + _apply(tree, x)
    return out


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _apply(low, x), _apply(high, x))


def log_odds(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.sum([_apply(t, x) for t in trees], axis=0) if len(x) else np.empty(0)


def to_column(trees: list[Tree], features: list[Column]) -> Column:
    """The log-odds as one expression over the features."""

    def one(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        f, t, low, high = tree
        return F.when(features[f] <= F.lit(t), one(low)).otherwise(one(high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + one(tree)
    return total


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score on a calibration set from which on the stated precision holds; infinite if none does."""
    order = np.argsort(-scores, kind="stable")
    s, good = scores[order], np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(s[1:] != s[:-1], True)
    ok = np.flatnonzero((good >= precision) & last)
    return float(s[ok[-1]]) if len(ok) else float("inf")
