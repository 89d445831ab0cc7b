"""Gradient-boosted trees with logistic loss and isotonic calibration, over small feature tables.

Training takes a bounded sample of feature rows; scoring is vectorised and runs inside tasks. Both
are free of randomness, so equal samples give equal models."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: per tree the feature and threshold of every inner node, level by
    level, and the value of every leaf."""

    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(rows) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2,
    bins: int = 32, least: float = 2.0, shrink: float = 1.0,
) -> Trees:
    """Boosted trees for labels 0 and 1. `least` is the least sum of curvature in a leaf."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
    model = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    margin = np.full(n, model.base)
    for _ in range(rounds):
        p = sigmoid(margin)
        slope, curve = y - p, p * (1 - p)
        feature = np.zeros(2**depth - 1, dtype=np.int64)
        threshold = np.full(2**depth - 1, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                at = (node - first) * (bins + 1) + codes[j]
                size = many * (bins + 1)
                g = np.bincount(at, slope, size).reshape(many, -1).cumsum(axis=1)
                h = np.bincount(at, curve, size).reshape(many, -1).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = (
                    g**2 / (h + shrink) + (g_all - g) ** 2 / (h_all - h + shrink)
                    - g_all**2 / (h_all + shrink)
                )
                gain[(h < least) | (h_all - h < least)] = 0
                gain = gain[:, : len(cuts[j])]
                cut = gain.argmax(axis=1)
                top = gain[np.arange(many), cut]
                better = top > best
                best[better] = top[better]
                feature[first : first + many][better] = j
                threshold[first : first + many][better] = cuts[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, slope, 2**depth), np.bincount(leaf, curve, 2**depth)
        value = rate * g / (h + shrink)
        margin += value[leaf]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.leaves.append(value)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of the non-decreasing step fit of the labels."""
    levels, at = np.unique(margin, return_inverse=True)
    weight = np.bincount(at).astype(float)
    total = np.bincount(at, y)
    blocks: list[list[float]] = []  # sum, weight, first and last level
    for i, (s, w) in enumerate(zip(total, weight, strict=True)):
        blocks.append([s, w, i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2], last]
    knots, values = [], []
    for s, w, first, last in blocks:
        for i in dict.fromkeys((int(first), int(last))):
            knots.append(levels[i])
            values.append((s + 0.5) / (w + 1))  # a half count each way: never quite 0 or 1
    return np.array(knots), np.maximum.accumulate(np.array(values)) if values else np.array([])


def calibrated(margin: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Calibrated share of label 1; a hundredth of the uncalibrated one orders rows inside a step."""
    if not len(knots):
        return sigmoid(margin)
    return 0.99 * np.interp(margin, knots, values) + 0.01 * sigmoid(margin)
