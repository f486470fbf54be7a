"""Histogram gradient-boosted trees for a binary label, on numpy arrays.

Training takes a bounded sample; the trained trees are flattened into arrays, so
that a block of rows walks all trees without a Python loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays: a node's children are `left` and `left` + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total = np.full(len(rows), self.start)
        at_row = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                go_right = rows[at_row, self.feature[node]] > self.threshold[node]
                node = np.where(self.left[node] < 0, node, self.left[node] + go_right)
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-total))


def bin_edges(rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """Up to `bins` - 1 cut points per feature, at quantiles of the distinct values."""
    edges = []
    for column in rows.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
            edges.append(values)
        else:
            edges.append((values[:-1] + values[1:]) / 2)
    return edges


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    min_rows: int = 8,
    ridge: float = 1.0,
) -> Forest:
    """Boost trees on the logistic loss; without both labels, a constant."""
    n, n_features = rows.shape
    positive = float(labels.sum())
    mean = (positive + 0.5) / (n + 1.0)
    start = float(np.log(mean / (1 - mean)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if 0 < positive < n:
        edges = bin_edges(rows, bins)
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)], axis=1)
        offsets = np.arange(n_features) * bins
        total = np.full(n, start)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-total))
            gradient, weight = labels - p, np.maximum(p * (1 - p), 1e-6)
            roots.append(len(feature))
            open_nodes = [(_new_node(feature, threshold, left, value), np.arange(n), 0)]
            while open_nodes:
                node, members, level = open_nodes.pop()
                g, h = gradient[members], weight[members]
                value[node] = rate * g.sum() / (h.sum() + ridge)
                split = None
                if level < depth and len(members) >= 2 * min_rows:
                    split = _best_split(binned[members], g, h, offsets, n_features, bins, min_rows, ridge)
                if split is None:
                    total[members] += value[node]
                    continue
                column, cut = split
                feature[node], threshold[node] = column, edges[column][cut]
                goes_right = binned[members, column] > cut
                left[node] = _new_node(feature, threshold, left, value)
                _new_node(feature, threshold, left, value)
                open_nodes.append((left[node], members[~goes_right], level + 1))
                open_nodes.append((left[node] + 1, members[goes_right], level + 1))
    return Forest(
        np.array(feature, dtype=np.int64),
        np.array(threshold, dtype=np.float64),
        np.array(left, dtype=np.int64),
        np.array(value, dtype=np.float64),
        np.array(roots, dtype=np.int64),
        depth,
        start,
    )


def _new_node(feature: list, threshold: list, left: list, value: list) -> int:
    feature.append(0)
    threshold.append(0.0)
    left.append(-1)
    value.append(0.0)
    return len(feature) - 1


def _best_split(binned, g, h, offsets, n_features, bins, min_rows, ridge):
    """(feature, bin) with the largest gain, from one histogram over all features."""
    flat = (binned + offsets).ravel()
    shape = (n_features, bins)
    size = n_features * bins
    g_sum = np.bincount(flat, np.repeat(g, n_features), size).reshape(shape).cumsum(axis=1)
    h_sum = np.bincount(flat, np.repeat(h, n_features), size).reshape(shape).cumsum(axis=1)
    count = np.bincount(flat, minlength=size).reshape(shape).cumsum(axis=1)
    g_all, h_all, n_all = g.sum(), h.sum(), len(g)
    gain = (
        g_sum**2 / (h_sum + ridge)
        + (g_all - g_sum) ** 2 / (h_all - h_sum + ridge)
        - g_all**2 / (h_all + ridge)
    )
    gain[(count < min_rows) | (n_all - count < min_rows)] = -np.inf
    best = int(np.argmax(gain))
    if not gain.ravel()[best] > 1e-6:
        return None
    return divmod(best, bins)
