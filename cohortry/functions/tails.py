"""Tail probabilities for one-row results, by continued fraction and exact sums."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Modified Lentz evaluation of the incomplete beta continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1_000_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(statistic: float, df: float) -> float:
    if math.isinf(statistic):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + statistic * statistic))


def normal_two_sided(z: float) -> float:
    return 0.0 if math.isinf(z) else math.erfc(abs(z) / math.sqrt(2.0))


def sign_test_two_sided(a: int, b: int) -> float:
    """Exact two-sided binomial(1/2) p-value of discordant counts."""
    n, low = a + b, min(a, b)
    if n == 0:
        return 1.0
    return min(1.0, 2.0 * incomplete_beta(n - low, low + 1.0, 0.5))
