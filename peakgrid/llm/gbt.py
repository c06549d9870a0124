"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in flat arrays. A leaf is its own child on both sides, so that scoring takes depth equal steps for all rows and trees."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        out = np.full(len(x), self.base)
        for s in range(0, len(x), rows):
            part = x[s : s + rows]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            line = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[line, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out[s : s + rows] += self.value[at].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Fit to 0/1 targets. monotone: for a feature's number 1 (the score may only rise with it) or -1 (only fall); a child's values stay on its side of the split's middle."""
    n, k = x.shape
    sign = [(monotone or {}).get(f, 0) for f in range(k)]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) + np.arange(k) * bins if n else np.zeros((0, k), np.int64)
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots = []
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        nodes.append([0, 0, len(nodes), len(nodes), 0])
        todo = [(len(nodes) - 1, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, d, low, high = todo.pop()
            value = np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high)
            best = (1e-6, -1, 0, 0.0, 0.0)
            if d < depth and len(rows) > 1:
                flat = binned[rows].ravel()
                gs, hs = (np.bincount(flat, np.repeat(w[rows], k), k * bins).reshape(k, bins) for w in (g, h))
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                loss = lambda a, b, v: a * v + 0.5 * (b + ridge) * v * v
                gain = loss(g[rows].sum(), h[rows].sum(), value) - loss(gl, hl, vl) - loss(gr, hr, vr)
                gain[(hl < least) | (hr < least)] = -1
                for f, s in enumerate(sign):
                    if s:
                        gain[f, s * (vr[f] - vl[f]) < 0] = -1
                    gain[f, len(edges[f]) :] = -1
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > best[0]:
                    best = (gain[f, b], f, b, vl[f, b], vr[f, b])
            if best[1] < 0:
                nodes[at][4] = rate * value
                score[rows] += rate * value
                continue
            _, f, b, a, c = best
            goes = binned[rows, f] <= b + f * bins
            nodes[at][:4] = [f, edges[f][b], len(nodes), len(nodes) + 1]
            mid = (a + c) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[sign[f]]
            for side, (lo, hi) in zip((goes, ~goes), bounds, strict=True):
                nodes.append([0, 0, len(nodes), len(nodes), 0])
                todo.append((len(nodes) - 1, rows[side], d + 1, lo, hi))
    t = np.array(nodes, float).reshape(-1, 5)
    whole = lambda c: t[:, c].astype(np.int32)
    return Trees(base, depth, np.array(roots, np.int32), whole(0), t[:, 1], whole(2), whole(3), t[:, 4])
