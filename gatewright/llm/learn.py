"""Small learners for bounded samples: boosted trees on binned features, logistic regression, isotonic steps."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class BoostedTrees:
    """Gradient boosting of the logistic loss: level-wise trees of fixed depth over quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 0.4):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
        binned = self._binned(x)
        share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.start, self.rounds = float(np.log(share / (1 - share))), []
        margin = np.full(n, self.start)
        for _ in range(self.trees if n else 0):
            p = sigmoid(margin)
            tree, leaf = self._grow(binned, p - y, p * (1 - p))
            self.rounds.append(tree)
            margin += tree[2][leaf]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        n, width = binned.shape
        node = np.zeros(n, np.int64)
        features, cuts = [], []
        for level in range(self.depth):
            count = 1 << level
            g_all, h_all = (np.bincount(node, w, minlength=count) for w in (grad, hess))
            best = np.full(count, 1e-9)
            feature, cut = np.zeros(count, np.int64), np.full(count, self.bins + 1)
            for j in range(width):
                at = node * (self.bins + 1) + binned[:, j]
                g, h = (np.bincount(at, w, minlength=count * (self.bins + 1)).reshape(count, -1).cumsum(axis=1)[:, :-1] for w in (grad, hess))
                gain = g**2 / (h + self.ridge) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + self.ridge) - (g_all**2 / (h_all + self.ridge))[:, None]
                gain[(h < self.least) | (h_all[:, None] - h < self.least)] = -1
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best = np.where(better, gain[np.arange(count), top], best)
                feature, cut = np.where(better, j, feature), np.where(better, top, cut)
            features.append(feature)
            cuts.append(cut)
            node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
        g, h = (np.bincount(node, w, minlength=1 << self.depth) for w in (grad, hess))
        return (features, cuts, -self.rate * g / (h + self.ridge)), node

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for features, cuts, leaves in self.rounds:
            node = np.zeros(len(x), np.int64)
            for feature, cut in zip(features, cuts, strict=True):
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            out += leaves[node]
        return out


class Isotonic:
    """Pool-adjacent-violators on scores; between the pools' centres the fitted value is linear."""

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        pools: list[list[float]] = []  # value, weight, sum of scores
        for v, t in sorted(zip(s.tolist(), y.tolist(), strict=True)):
            pools.append([t, 1.0, v])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                b, a = pools.pop(), pools.pop()
                w = a[1] + b[1]
                pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
        self.x = np.array([p[2] / p[1] for p in pools] or [0.0])
        self.y = np.array([(p[0] * p[1] + 0.1) / (p[1] + 0.2) if p[1] < 3 else p[0] for p in pools] or [0.0])
        self.y = np.maximum.accumulate(self.y)
        return self

    def apply(self, s: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(s, self.x, self.y), 0.0, 1.0)


class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps; rows may have weights."""

    def __init__(self, ridge: float = 1.0, steps: int = 12):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.scale = np.where(self.scale > 1e-9, self.scale, 1.0)
        z = self._z(x)
        weight = np.ones(len(x)) if weight is None else weight
        self.beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[0] = 1e-3
        for _ in range(self.steps):
            p = sigmoid(z @ self.beta)
            slope = z.T @ (weight * (y - p)) - penalty * self.beta
            bend = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6)
            step = np.linalg.solve(bend, slope)
            self.beta += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        return self

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.beta
