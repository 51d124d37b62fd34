"""Tails of distributions that have no built-in function."""

from __future__ import annotations

import math


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below ``a + 1``, a continued fraction above."""
    if x <= 0.0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1.0
            term *= x / n
            total += term
        return max(1.0 - front * total, 0.0)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    out = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / (step * d + b or tiny)
        c = b + step / c or tiny
        out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * out


def chi_square_tail(x: float, freedom: float) -> float:
    """The probability that a chi-square variable exceeds ``x``."""
    return upper_gamma(freedom / 2.0, x / 2.0)
