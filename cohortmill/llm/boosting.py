"""Boosted regression trees for a bounded table of examples, and calibration of their scores."""

from __future__ import annotations

import numpy as np

BINS = 32


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2,
              ridge: float = 1.0) -> dict:
    """Logistic boosting with Newton leaves; splits are chosen from quantile cuts of each feature.

    A tree is complete: per level and node one (feature, cut), rows above the cut go right.
    """
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    width = x.shape[1]
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, np.maximum(p * (1 - p), 1e-9)
        node, features, limits = np.zeros(len(y), np.int64), [], []
        for level in range(depth):
            nodes = 1 << level
            feature, limit = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            best = np.full(nodes, 1e-9)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                key = node * (BINS + 1) + binned[:, f]
                g = np.bincount(key, slope, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                h = np.bincount(key, bend, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = (g ** 2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge)
                        - total_g ** 2 / (total_h + ridge))[:, :len(cuts[f])]
                at = gain.argmax(axis=1)
                value = gain[np.arange(nodes), at]
                better = value > best
                best[better], feature[better] = value[better], f
                limit[better] = cuts[f][at[better]]
            features.append(feature)
            limits.append(limit)
            node = node * 2 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaves = 1 << depth
        leaf = rate * np.bincount(node, slope, leaves) / (np.bincount(node, bend, leaves) + ridge)
        margin += leaf[node]
        trees.append((features, limits, leaf))
    return {"base": base, "trees": trees}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    total, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for features, limits, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for feature, limit in zip(features, limits):
            node = node * 2 + (x[rows, feature[node]] > limit[node])
        total += leaf[node]
    return total


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns held-out margins into probabilities."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(slope * margin + offset)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()]) + 1e-3 * np.array([slope - 1, offset])
        h = np.array([[(w * margin ** 2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(offset)


def probabilities(margin: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * margin + curve[1], -30, 30)))


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on at least ``precision`` of the examples are positive;
    above one (nothing passes) if there is none."""
    order = np.argsort(-p, kind="stable")
    ranked, hits = p[order], np.cumsum(y[order])
    ends = np.r_[ranked[1:] != ranked[:-1], True]
    fine = ends & (hits / np.arange(1, len(p) + 1) >= precision)
    return float(ranked[np.flatnonzero(fine)[-1]]) if fine.any() else 1.1
