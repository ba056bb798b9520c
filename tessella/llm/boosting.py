"""Gradient boosting of small trees on the driver, and its trees as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tree: (feature, threshold, tree where it is at most that, tree beyond) or a leaf's value.
Tree = tuple | float


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int, least: int) -> Tree:
    leaf = float(residual.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(residual) < 2 * least:
        return leaf
    best, gain = None, 1e-9 + residual.sum() ** 2 / (weight.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, r, w = x[order, f], np.cumsum(residual[order]), np.cumsum(weight[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            score = r[cut] ** 2 / (w[cut] + 1) + (r[-1] - r[cut]) ** 2 / (w[-1] - w[cut] + 1)
            k = int(score.argmax())
            if score[k] > gain:
                gain, best = score[k], (f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best is None:
        return leaf
    f, t = best
    left = x[:, f] <= t
    return f, t, _grow(x[left], residual[left], weight[left], depth - 1, least), _grow(x[~left], residual[~left], weight[~left], depth - 1, least)


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _value(low, x), _value(high, x))


class Boosted:
    """Logistic boosting; `calibrate` fits slope and offset on rows that were not trained on."""

    def __init__(self, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 10):
        self.size, self.depth, self.rate, self.least = trees, depth, rate, least
        self.trees: list[Tree] = []
        self.slope, self.offset = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        score = np.zeros(len(y))
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-score))
            tree = _grow(x, y - p, p * (1 - p), self.depth, self.least)
            self.trees.append(tree)
            score += self.rate * _value(tree, x)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.rate * sum(_value(t, x) for t in self.trees)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        s = self.raw(x)
        a, b = 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            g, w = p - target, p * (1 - p) + 1e-9
            h = np.array([[np.sum(w * s * s) + 1e-6, np.sum(w * s)], [np.sum(w * s), np.sum(w) + 1e-6]])
            step = np.linalg.solve(h, [np.sum(g * s), np.sum(g)])
            a, b = a - step[0], b - step[1]
        self.slope, self.offset = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.offset)))

    def _flat(self) -> tuple[list[int], list[float], list[float]]:
        """(features, thresholds, leaves) of all trees filled up to full depth, nodes level by level."""
        features, limits, leaves = [], [], []
        for tree in self.trees:
            level = [tree]
            for _ in range(self.depth):
                split = [x if isinstance(x, tuple) else (0, 1e300, x, x) for x in level]
                features += [x[0] for x in split]
                limits += [x[1] for x in split]
                level = [y for x in split for y in x[2:]]
            leaves += level
        return features, limits, leaves

    def column(self, x: Column) -> Column:
        """The calibrated probability over an array of features. The trees are constant arrays, walked from level to level."""
        features, limits, leaves = (F.split(F.lit(",".join(map(repr, a))), ",").cast(f"array<{t}>") for a, t in zip(self._flat(), ("int", "double", "double"), strict=True))
        nodes = 2**self.depth - 1

        def add(total: Column, k: Column) -> Column:
            place = F.lit(0)
            for level in range(self.depth):
                at = k * nodes + place + 2**level
                place = place * 2 + F.when(F.element_at(x, F.element_at(features, at) + 1) <= F.element_at(limits, at), 0).otherwise(1)
            return total + F.element_at(leaves, k * (nodes + 1) + place + 1)

        score = F.aggregate(F.sequence(F.lit(0), F.lit(len(self.trees) - 1)), F.lit(0.0), add) * self.rate
        return 1 / (1 + F.exp(-(self.slope * score + self.offset)))
