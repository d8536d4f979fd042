"""Two-sided p-value of Student's t from the regularised incomplete beta function."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float, steps: int = 500) -> float:
    """Modified Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300

    def guard(value: float) -> float:
        return value if abs(value) > tiny else tiny

    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    result = d
    for m in range(1, steps):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / guard(1.0 + term * d)
            c = guard(1.0 + term / c)
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, degrees: float) -> float:
    return incomplete_beta(degrees / 2.0, 0.5, degrees / (degrees + t * t))
