"""Gradient-boosted trees for binary labels, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Newton boosting of shallow trees on binned features, with logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x: (rows, features), y: 0 or 1. A tree is complete: each inner node has a feature and a cut."""
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.base)
        width, n_feat = self.bins + 1, x.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                n_nodes, start = 1 << level, (1 << level) - 1
                local = node - start
                flat = (local[:, None] * n_feat + np.arange(n_feat)) * width + binned
                sums = [np.bincount(flat.ravel(), np.repeat(v, n_feat), n_nodes * n_feat * width).reshape(n_nodes, n_feat, width) for v in (g, h)]
                left_g, left_h = (s.cumsum(axis=2)[:, :, :-1] for s in sums)
                all_g, all_h = (s.sum(axis=2)[:, :, None] for s in sums)
                value = lambda a, b: a * a / (b + self.ridge)
                gain = value(left_g, left_h) + value(all_g - left_g, all_h - left_h) - value(all_g, all_h)
                best = gain.reshape(n_nodes, -1).argmax(axis=1)
                at = np.zeros(n_nodes, np.int64)
                for i, b in enumerate(best):
                    f, c = divmod(int(b), width - 1)
                    feature[start + i] = f
                    if gain[i, f, c] > 1e-6 and c < len(self.cuts[f]):
                        cut[start + i], at[i] = self.cuts[f][c], c
                    else:
                        at[i] = width
                right = binned[np.arange(len(y)), feature[node]] > at[local]
                node = 2 * node + 1 + right
            leaf = node - ((1 << self.depth) - 1)
            total_g, total_h = (np.bincount(leaf, v, 1 << self.depth) for v in (g, h))
            value = -self.rate * total_g / (total_h + self.ridge)
            score += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - ((1 << self.depth) - 1)]
        return out


def threshold_for(log_odds: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest log-odds from which on at least this share of rows is positive (infinite if there is none)."""
    order = np.argsort(-log_odds, kind="stable")
    hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.concatenate([np.diff(log_odds[order]) != 0, [True]])  # a threshold can't part equal scores
    good = np.flatnonzero((hits >= precision) & last)
    return float(log_odds[order][good[-1]]) if len(good) else float("inf")
