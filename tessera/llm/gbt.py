"""Gradient-boosted trees for two classes in numpy, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    edges: list[np.ndarray]  #: of each feature, the bounds between bins
    base: float
    trees: list[list[tuple]]  #: nodes (feature, bin, left, right) or (None, value)
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = _bin(x, self.edges)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at, todo = np.zeros(len(x), dtype=int), [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if tree[node][0] is None:
                    out[rows] += tree[node][1]
                    continue
                feature, cut, left, right = tree[node]
                low = binned[rows, feature] <= cut
                todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)


def _grow(binned, grad, hess, depth: int, rate: float, least: float) -> list[tuple]:
    nodes: list[tuple] = []

    def leaf(rows):
        return (None, -rate * grad[rows].sum() / (hess[rows].sum() + 1.0))

    def build(rows, left_depth) -> int:
        own = len(nodes)
        nodes.append(())
        best = (1e-6, None, None)
        if left_depth:
            total_g, total_h = grad[rows].sum(), hess[rows].sum()
            for f in range(binned.shape[1]):
                g = np.bincount(binned[rows, f], weights=grad[rows], minlength=BINS + 1).cumsum()
                h = np.bincount(binned[rows, f], weights=hess[rows], minlength=BINS + 1).cumsum()
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                gain[(h < least) | (total_h - h < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] is None:
            nodes[own] = leaf(rows)
        else:
            low = binned[rows, best[1]] <= best[2]
            nodes[own] = (best[1], best[2], build(rows[low], left_depth - 1), build(rows[~low], left_depth - 1))
        return own

    build(np.arange(len(grad)), depth)
    return nodes


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 2.0) -> Boosted:
    """Fit on two thirds of the rows, every third held back to calibrate: a logistic curve from margin to probability."""
    held = np.arange(len(y)) % 3 == 2
    xs, ys = x[~held], y[~held].astype(float)
    edges = [np.unique(np.quantile(xs[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = _bin(xs, edges)
    rate_of = (ys.sum() + 1) / (len(ys) + 2)
    model = Boosted(edges, float(np.log(rate_of / (1 - rate_of))), [])
    margin = np.full(len(ys), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, p - ys, p * (1 - p), depth, rate, least)
        model.trees.append(tree)
        margin += Boosted(edges, 0.0, [tree]).margin(xs)
    own, target = model.margin(x[held]), y[held].astype(float)
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps, kept from the infinite slope of data that separate
        p = 1 / (1 + np.exp(-(a * own + b)))
        g = np.array([((p - target) * own).sum() + 0.1 * (a - 1), (p - target).sum() + 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * own**2).sum() + 0.1, (w * own).sum()], [(w * own).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = float(a), float(b)
    return model


def threshold(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float, doubt: int = 0) -> float:
    """The smallest probability above which this share of the rows are positive, with so many more mistakes than are seen; 1.01 where none is."""
    p = model.probability(x)
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + doubt)
    good = np.flatnonzero(share >= precision)
    return float(p[order][good[-1]]) if len(good) else 1.01
