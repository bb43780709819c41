"""Distribution functions for fitted parameters and small tables (numbers, not columns)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def chi2_quantile(p: float, k: int) -> float:
    """By bisection on the regularised lower incomplete gamma function."""
    low, high = 0.0, max(10.0, 20.0 * k)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_share(k / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > 1e-16 * abs(total):
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by numeric integration of its density in an angle."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    # with t = sqrt(df) tan(a), the density becomes cos(a)^(df - 1)
    a = math.atan(abs(t) / math.sqrt(df))
    x = np.linspace(a, math.pi / 2, 20001)
    area = float(np.trapezoid(np.cos(x) ** (df - 1), x))
    return min(1.0, 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi))


def binomial_tail(hits: int, n: int, p: float = 0.5) -> float:
    """Chance of ``hits`` or more of ``n``."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(hits, n + 1))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
