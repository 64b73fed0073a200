"""Gradient-boosted trees with monotonic constraints, kept as numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees side by side: row t of each array holds tree t's nodes, the root first; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of the leaves that each row reaches in all trees, one level of all trees at a time."""
        n, t = len(x), len(self.feature)
        if not n or not t:
            return np.full(n, self.base)
        trees, rows = np.arange(t), np.arange(n)[:, None]
        at = np.zeros((n, t), np.int32)
        for _ in range(self.depth):
            low = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(low, self.left[trees, at], self.right[trees, at])
        return self.base + self.value[trees, at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Of every node but the roots the conditions on the way to it: (feature, whether <=, threshold)."""
        out = []
        for t in range(len(self.feature)):
            open_ = [(0, ())]
            while open_:
                at, path = open_.pop()
                if path:
                    out.append(path)
                if self.left[t, at] != at:
                    f, c = int(self.feature[t, at]), float(self.threshold[t, at])
                    open_ += [(int(self.left[t, at]), (*path, (f, True, c))), (int(self.right[t, at]), (*path, (f, False, c)))]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 2.0, min_rows: int = 15, bins: int = 48, monotone: tuple[int, ...] = ()) -> Forest:
    """Logistic boosting on histograms of quantile bins.

    ``monotone`` has for each feature 1 (the score never falls as it grows), -1 (never rises) or 0: a split that
    would break that is not taken, and the children of one that keeps it are held to either side of its middle.
    Without rows of both classes the forest is a constant.
    """
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base, width = float(np.log(p / (1 - p))), 2 ** (depth + 1) - 1
    empty = np.zeros((0, width))
    if len(np.unique(y)) < 2:
        return Forest(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, base, depth)
    signs = np.array(monotone or [0] * x.shape[1])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], 1)
    margin, arrays = np.full(len(y), base), [[] for _ in range(5)]
    for _ in range(n_trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        feature, threshold, value = np.zeros(width, int), np.zeros(width), np.zeros(width)
        left, right, used = np.arange(width), np.arange(width), 1
        step = np.zeros(len(y))
        open_ = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_:
            at, rows, lo, hi, d = open_.pop()
            value[at] = np.clip(-g[rows].sum() / (h[rows].sum() + l2), lo, hi) * rate
            split = _best_split(binned[rows], g[rows], h[rows], edges, signs, lo, hi, l2, min_rows) if d < depth else None
            if split is None:
                step[rows] = value[at]
                continue
            f, cut, wl, wr = split
            feature[at], threshold[at], left[at], right[at] = f, edges[f][cut], used, used + 1
            goes, mid = binned[rows, f] <= cut, (wl + wr) / 2
            low = (lo, mid) if signs[f] > 0 else (mid, hi) if signs[f] < 0 else (lo, hi)
            high = (mid, hi) if signs[f] > 0 else (lo, mid) if signs[f] < 0 else (lo, hi)
            open_ += [(used, rows[goes], *low, d + 1), (used + 1, rows[~goes], *high, d + 1)]
            used += 2
        margin += step
        for kept, own in zip(arrays, (feature, threshold, left, right, value)):
            kept.append(own)
    return Forest(*map(np.array, arrays), base, depth)


def _best_split(binned, g, h, edges, signs, lo, hi, l2, min_rows):
    """The feature, bin and both children's weights of the split with the most gain, or None."""
    if len(g) < 2 * min_rows:
        return None
    cost = lambda G, H, w: G * w + 0.5 * (H + l2) * w * w
    G, H = g.sum(), h.sum()
    whole = cost(G, H, np.clip(-G / (H + l2), lo, hi))
    best = (1e-6, None)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        n = len(e) + 1
        gl, hl, nl = (np.cumsum(np.bincount(binned[:, f], w, n))[:-1] for w in (g, h, None))
        wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(G - gl) / (H - hl + l2), lo, hi)
        gain = whole - cost(gl, hl, wl) - cost(G - gl, H - hl, wr)
        gain[(nl < min_rows) | (len(g) - nl < min_rows) | (signs[f] * (wr - wl) < 0)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (f, k, wl[k], wr[k]))
    return best[1]
