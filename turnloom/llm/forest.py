"""A random forest of binary labels in numpy, small enough to be sent with the code."""

from __future__ import annotations

import numpy as np


class Forest:
    """Gini trees on bootstrap samples with a random choice of features at each node."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 7) -> None:
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        tries = max(2, int(x.shape[1] ** 0.5))
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            self.nodes.append(self._tree(x[rows], y[rows].astype(float), rng, tries))
        return self

    def _tree(self, x, y, rng, tries):
        feature, limit, left, value = [], [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            p = y[rows].mean()
            feature.append(-1), limit.append(0.0), left.append((0, 0)), value.append(p)
            if depth == self.depth or len(rows) < 2 * self.least or p in (0.0, 1.0):
                return me
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                v = x[rows, f]
                cuts = np.unique(np.quantile(v, np.linspace(0.05, 0.95, 15), method="midpoint"))
                low = v[:, None] <= cuts
                n = low.sum(0)
                one = (low * y[rows, None]).sum(0)
                ok = (n >= self.least) & (len(rows) - n >= self.least)
                if not ok.any():
                    continue
                a, b = one / np.maximum(n, 1), (y[rows].sum() - one) / np.maximum(len(rows) - n, 1)
                gain = p * (1 - p) * len(rows) - n * a * (1 - a) - (len(rows) - n) * b * (1 - b)
                gain[~ok] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], int(f), float(cuts[k]))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                feature[me], limit[me] = best[1], best[2]
                a = grow(rows[low], depth + 1)
                left[me] = (a, grow(rows[~low], depth + 1))
            return me

        grow(np.arange(len(x)), 0)
        return np.array(feature), np.array(limit), np.array(left), np.array(value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' shares of label 1 for each row."""
        total = np.zeros(len(x))
        for feature, limit, left, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > limit[at]
                at = np.where(inner, left[at, right.astype(int)], at)
            total += value[at]
        return total / len(self.nodes)
