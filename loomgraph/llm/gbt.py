"""Gradient-boosted trees on binned dense features, and isotonic calibration; both small enough for the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Logistic boosting of trees of fixed depth; trees are arrays of (feature, threshold) by node and of leaf values."""

    base: float = 0.0
    depth: int = 3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 64, ridge: float = 1.0) -> Boosted:
    """Newton boosting with histogram splits. Needs both classes; ties between splits go to the first feature and bin."""
    n, m = x.shape
    cuts = []
    for j in range(m):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) < bins else np.unique(np.quantile(mid, np.linspace(0, 1, bins - 1))))
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p = y.mean()
    model = Boosted(float(np.log(p / (1 - p))), depth)
    f = np.full(n, model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = q - y, q * (1 - q)
        inner = 2**depth - 1
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**depth)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            choice = {}
            for j in range(m):
                k = len(cuts[j]) + 1
                if k < 2:
                    continue
                at = local * k + binned[:, j]
                gs = np.bincount(at, g, width * k).reshape(width, k).cumsum(axis=1)
                hs = np.bincount(at, h, width * k).reshape(width, k).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, :-1]
                top = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(width), top] > best + 1e-12):
                    best[w] = gain[w, top[w]]
                    choice[int(w)] = (j, float(cuts[j][top[w]]))
            for w, (j, t) in choice.items():
                feature[first + w], threshold[first + w] = j, t
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        local = node - inner
        leaf = -rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        model.trees.append((feature, threshold, leaf))
        f += leaf[local]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the least-squares non-decreasing fit, by pooling adjacent violators."""
    values, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    stack: list[list[float]] = []  # mean, weight, first, last
    for i in range(len(values)):
        stack.append([mean[i], weight[i], i, i])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            m, w, _, last = stack.pop()
            top = stack[-1]
            top[0], top[1], top[3] = (top[0] * top[1] + m * w) / (top[1] + w), top[1] + w, last
    at = np.array([i for s in stack for i in (s[2], s[3])], dtype=np.int64)
    return values[at], np.array([m for s in stack for m in (s[0], s[0])])
