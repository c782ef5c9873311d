"""Gradient-boosted trees for a yes/no label in numpy: histogram splits, monotonic constraints.

Trees are kept as flat node arrays, so that scoring is a few vectorised steps a level.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Arrays over all nodes of all trees: feature (-1 at a leaf), cut, left, right, value."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 10, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.smooth = rounds, depth, rate, bins, least, smooth

    def fit(self, x: np.ndarray, y: np.ndarray, monotonic: np.ndarray) -> Boosted:
        """monotonic: for each feature 1 (score may only rise with it), -1 (only fall) or 0."""
        nodes: list[list[float]] = []
        self.roots: list[int] = []
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            self.roots.append(self._grow(nodes, codes, edges, g, h, np.arange(len(y)), self.depth, monotonic, -np.inf, np.inf, score))
        table = np.array(nodes)
        self.feature, self.left, self.right = (table[:, k].astype(np.int32) for k in (0, 2, 3))
        self.cut, self.value = table[:, 1], table[:, 4]
        return self

    def _grow(self, nodes, codes, edges, g, h, own, depth, monotonic, floor, top, score) -> int:
        node = len(nodes)
        value = float(np.clip(g[own].sum() / (h[own].sum() + self.smooth), floor, top))
        nodes.append([-1, 0.0, -1, -1, value * self.rate])
        best = self._split(codes, edges, g, h, own, monotonic, floor, top) if depth and len(own) >= 2 * self.least else None
        if best is None:
            score[own] += value * self.rate
            return node
        j, k, a, b = best
        goes = codes[own, j] <= k
        middle = (a + b) / 2
        bounds = {0: ((floor, top), (floor, top)), 1: ((floor, middle), (middle, top)), -1: ((middle, top), (floor, middle))}[int(monotonic[j])]
        left = self._grow(nodes, codes, edges, g, h, own[goes], depth - 1, monotonic, *bounds[0], score)
        right = self._grow(nodes, codes, edges, g, h, own[~goes], depth - 1, monotonic, *bounds[1], score)
        nodes[node] = [j, float(edges[j][k]), left, right, 0.0]
        return node

    def _split(self, codes, edges, g, h, own, monotonic, floor, top):
        total_g, total_h = g[own].sum(), h[own].sum()
        found, gain = None, 1e-6
        for j, e in enumerate(edges):
            if not len(e):
                continue
            c = codes[own, j]
            size = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
            lg = np.cumsum(np.bincount(c, g[own], len(e) + 1))[:-1]
            lh = np.cumsum(np.bincount(c, h[own], len(e) + 1))[:-1]
            rg, rh = total_g - lg, total_h - lh
            a = np.clip(lg / (lh + self.smooth), floor, top)
            b = np.clip(rg / (rh + self.smooth), floor, top)
            fall = lambda v, s, w: v * s - 0.5 * v * v * (w + self.smooth)
            value = float(np.clip(total_g / (total_h + self.smooth), floor, top))
            gains = fall(a, lg, lh) + fall(b, rg, rh) - fall(value, total_g, total_h)
            ok = (size >= self.least) & (len(own) - size >= self.least) & (monotonic[j] * (b - a) >= 0)
            gains = np.where(ok, gains, -np.inf)
            k = int(gains.argmax())
            if gains[k] > gain:
                found, gain = (j, k, float(a[k]), float(b[k])), gains[k]
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                goes = x[rows, np.maximum(f, 0)] <= self.cut[at]
                at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
            score += self.value[at]
        return 1 / (1 + np.exp(-score))
