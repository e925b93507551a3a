"""Gradient-boosted trees for a 0/1 label, and isotonic calibration, on small arrays in NumPy."""

from __future__ import annotations

import numpy as np


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 5.0, ridge: float = 1.0) -> dict:
    """Log-loss boosting with histogram splits. Returns base margin and flat arrays of full binary trees."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes = (1 << depth) - 1
    feature = np.zeros((rounds, nodes), dtype=np.int32)
    cut = np.full((rounds, nodes), np.inf)
    value = np.zeros((rounds, nodes + 1))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for node in range(nodes):
            own = np.flatnonzero(at == node)
            best = (1e-6, None, None)
            if len(own) >= 2 * least:
                gs, hs = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[own, j]
                    gl = np.cumsum(np.bincount(b, g[own], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[own], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(own) - nl < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] is not None:
                feature[t, node], cut[t, node] = best[1], edges[best[1]][best[2]]
            at[own] = 2 * node + 1 + (x[own, feature[t, node]] > cut[t, node])
        leaf = at - nodes
        gs, hs = np.bincount(leaf, g, nodes + 1), np.bincount(leaf, h, nodes + 1)
        value[t] = -rate * gs / (hs + ridge)
        margin += value[t][leaf]
    return {"base": base, "feature": feature, "cut": cut, "value": value, "depth": depth}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model["base"]), np.arange(len(x))
    nodes = (1 << model["depth"]) - 1
    for feature, cut, value in zip(model["feature"], model["cut"], model["value"]):
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(model["depth"]):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        out += value[at - nodes]
    return out


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising map from margin to probability: pooled blocks at their mean margin."""
    if not len(y):
        return np.array([-1.0, 1.0]), np.array([0.25, 0.75])
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean label, weight, sum of margins
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] * b[1] + 0.5) / (b[1] + 1) if b[0] in (0.0, 1.0) else b[0] for b in blocks])


def calibrated(knots: tuple[np.ndarray, np.ndarray], margin: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(margin, *knots), 0.0, 1.0)
