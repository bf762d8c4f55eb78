"""Survival functions for p-values.

Spark has neither erfc nor an incomplete gamma function. These are applied on the driver to single
results, one per test or per coefficient.
"""

from __future__ import annotations

import math

_TINY = 1e-300
_EPS = 1e-16


def gamma_survival(shape: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(shape, x): power series below shape+1, else a
    continued fraction evaluated with the modified Lentz method."""
    if x <= 0:
        return 1.0
    scale = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1.0 / shape
        step = shape
        while abs(term) > abs(total) * _EPS:
            step += 1
            term *= x / step
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - shape
    c = 1.0 / _TINY
    d = 1.0 / b
    fraction = d
    i = 0
    while True:
        i += 1
        a = i * (shape - i)
        b += 2.0
        d = 1.0 / (a * d + b or _TINY)
        c = b + a / c or _TINY
        change = c * d
        fraction *= change
        if abs(change - 1.0) < 1e-15 or i > 1_000_000:
            return scale * fraction


def chi2_tail(statistic: float, dof: int) -> float:
    return 1.0 if dof <= 0 else gamma_survival(dof / 2.0, statistic / 2.0)


def erfc_tail(z: float) -> float:
    """Two-sided p-value of a rank z, which the continuity correction may push below zero."""
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def normal_two_sided_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))
