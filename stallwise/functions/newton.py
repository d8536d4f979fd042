"""Damped Newton minimiser whose objective scores a batch of points per call.

One call is one Spark job, so a whole finite-difference stencil or a whole set of trial steps
costs a single pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np

DAMPINGS = (0.0, 1e-3, 1e-2, 0.1, 0.5, 2.0, 10.0, 100.0)
MAX_STEP = 2.0


def minimise(
    score: Callable[[list[np.ndarray]], np.ndarray],
    start: np.ndarray,
    iterations: int = 60,
    step: float = 1e-3,
    tolerance: float = 1e-9,
) -> tuple[np.ndarray, float, int]:
    """Return (point, value, iterations used); raise if the iterations do not suffice.

    Every call scores the damped steps together with the stencil around the undamped one, so a
    step that needs no damping costs one call.
    """
    size = len(start)
    pairs = list(combinations(range(size), 2))
    unit = np.eye(size) * step

    def stencil(centre: np.ndarray) -> list[np.ndarray]:
        return [centre, *(centre + unit), *(centre - unit), *[centre + unit[i] + unit[j] for i, j in pairs]]

    point = np.asarray(start, dtype=float)
    around = score(stencil(point))
    for used in range(1, iterations + 1):
        value = around[0]
        trials = _steps(point, around, pairs, step)
        results = np.nan_to_num(score(trials + stencil(trials[0])[1:]), nan=np.inf)
        best = int(np.argmin(results[: len(trials)]))
        gain = value - results[best]
        if gain > 0:
            point = trials[best]
        if gain < tolerance * max(1.0, abs(value)):
            return point, float(min(value, results[best])), used
        around = np.append(results[0], results[len(trials) :]) if best == 0 else score(stencil(point))
    raise RuntimeError(f"no convergence in {iterations} iterations; last point {point.tolist()}, value {float(around[0])}")


def _steps(point: np.ndarray, around: np.ndarray, pairs: list[tuple[int, int]], step: float) -> list[np.ndarray]:
    """Newton steps of increasing damping from the stencil values around ``point``."""
    size = len(point)
    value, up, down = around[0], around[1 : size + 1], around[size + 1 : 2 * size + 1]
    hessian = np.diag((up - 2 * value + down) / step**2)
    for (i, j), both in zip(pairs, around[2 * size + 1 :]):
        hessian[i, j] = hessian[j, i] = (both - up[i] - up[j] + value) / step**2
    roots, axes = np.linalg.eigh(hessian)
    slope = axes.T @ ((up - down) / (2 * step))
    steps = []
    for damping in DAMPINGS:
        move = -axes @ (slope / (np.maximum(np.abs(roots), 1e-8) + damping))
        length = np.linalg.norm(move)
        steps.append(point + move * min(1.0, MAX_STEP / max(length, 1e-300)))
    return steps
