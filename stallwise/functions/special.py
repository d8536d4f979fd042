"""Vectorised special functions for Arrow batches (NumPy only)."""

from __future__ import annotations

import numpy as np

# Stirling series coefficients B(2k) / (2k (2k - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_SHIFT = 9


def log_gamma(x) -> np.ndarray:
    """ln Gamma for positive arguments: shift upwards, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    product = np.ones_like(x)
    for step in range(_SHIFT):
        product = product * (x + step)
    y = x + _SHIFT
    series = np.zeros_like(y)
    power = 1.0 / y
    for coefficient in _STIRLING:
        series = series + coefficient * power
        power = power / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_beta(a, b) -> np.ndarray:
    return log_gamma(a) + log_gamma(b) - log_gamma(np.asarray(a) + np.asarray(b))


def hypergeometric(a, b, c, z, tolerance: float = 1e-15, terms: int = 100_000) -> np.ndarray:
    """Power series of 2F1(a, b; c; z) for 0 <= z < 1, summed until every element settles."""
    a, b, c, z = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, c, z)])
    total, term = np.ones(z.shape), np.ones(z.shape)
    for k in range(terms):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total = total + term
        if np.all(np.abs(term) <= tolerance * np.abs(total)):
            return total
    raise ArithmeticError(f"2F1 did not settle in {terms} terms, largest argument {z.max()}")
