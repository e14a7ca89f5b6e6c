"""Gradient-boosted trees for a yes-or-no target, in numpy, over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: per inner node a feature and a threshold, per leaf a value."""

    start: float
    features: np.ndarray  # trees x inner nodes
    thresholds: np.ndarray
    leaves: np.ndarray  # trees x leaves
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss; splits are at quantiles of each feature."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins)[1:-1], method="lower")) for column in x.T]
    codes = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    # features with one split are summed together, as a matrix product
    single = np.array([j for j, e in enumerate(edges) if len(e) == 1], np.int64)
    upper = np.ascontiguousarray((codes[:, single] > 0).T, dtype=np.float32)
    rows = np.arange(len(y))
    inner, share = 2**depth - 1, float(np.average(y, weights=weight))
    start = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    score = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best, g_all, h_all = np.full(width, 1e-9), np.bincount(local, grad, width), np.bincount(local, hess, width)
            base = g_all**2 / (h_all + ridge)
            sums = np.zeros((len(y), 2 * width), np.float32)
            sums[rows, local], sums[rows, width + local] = grad, hess
            above = (upper @ sums).astype(np.float64)
            for j, e in enumerate(edges):
                if len(e) < 2:
                    continue
                size = len(e) + 1
                g = np.cumsum(np.bincount(local * size + codes[:, j], grad, width * size).reshape(width, size), axis=1)[:, :-1]
                h = np.cumsum(np.bincount(local * size + codes[:, j], hess, width * size).reshape(width, size), axis=1)[:, :-1]
                _improve(best, feature[first:][:width], threshold[first:][:width], j, e, _gain(g, h, g_all, h_all, base, least, ridge))
            for k, j in enumerate(single):
                g, h = (g_all - above[k, :width])[:, None], (h_all - above[k, width:])[:, None]
                _improve(best, feature[first:][:width], threshold[first:][:width], j, edges[j], _gain(g, h, g_all, h_all, base, least, ridge))
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Forest(start, np.array(features), np.array(thresholds), np.array(leaves), depth)


def _gain(g: np.ndarray, h: np.ndarray, g_all: np.ndarray, h_all: np.ndarray, base: np.ndarray, least: float, ridge: float) -> np.ndarray:
    """What splitting each node at each edge gains; g and h are the sums on the lower side."""
    gain = g**2 / (h + ridge) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + ridge) - base[:, None]
    gain[(h < least * 0.05) | (h_all[:, None] - h < least * 0.05)] = 0
    return gain


def _improve(best: np.ndarray, feature: np.ndarray, threshold: np.ndarray, j: int, edges: np.ndarray, gain: np.ndarray) -> None:
    at = gain.argmax(axis=1)
    top = gain[np.arange(len(best)), at]
    better = top > best
    best[better], feature[better], threshold[better] = top[better], j, edges[at[better]]
