"""Isotonic regression: raw scores to probabilities that never fall as the score rises."""

from __future__ import annotations

import numpy as np


def fit_isotonic(scores, positives, totals) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (score, weight of positives, weight of all).

    Returns the knots of a piecewise linear map; equal scores are pooled first. Without any
    weight the map is constant at 0.
    """
    scores = np.asarray(scores, float)
    positives, totals = np.asarray(positives, float), np.asarray(totals, float)
    used = totals > 0
    scores, at = np.unique(scores[used], return_inverse=True)
    if not len(scores):
        return np.array([0.0]), np.array([0.0])
    positives = np.bincount(at, positives[used])
    totals = np.bincount(at, totals[used])
    pools: list[list[float]] = []  # score mass, positives, total
    for x, p, n in zip(scores, positives, totals, strict=True):
        pools.append([x * n, p, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([m / n for m, _, n in pools]), np.array([p / n for _, p, n in pools])


def apply_isotonic(model: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(scores, *model), 0.0, 1.0)
