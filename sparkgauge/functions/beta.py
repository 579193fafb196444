"""Incomplete beta function and the tails built on it, as column expressions for rows that are already aggregated."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

STEPS = 300


def log_gamma(z: Column) -> Column:
    """Stirling's series, after the argument is raised above 8."""
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, k: s + F.log(z + k))
    y = z + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, evaluated from its far end."""
    def step(value: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / value)

    inner = F.aggregate(F.sequence(F.lit(STEPS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda v, m: step(v, m.cast("double")))
    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / inner)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * _fraction(a, b, x) / a
    high = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def t_tail(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t."""
    half = beta_inc(df / 2.0, F.lit(0.5), df / (df + t * t)) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def sign_test(positive: Column, negative: Column) -> Column:
    """Exact two-sided sign test."""
    n, k = positive + negative, F.least(positive, negative)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * beta_inc(n - k, k + 1, F.lit(0.5))))


def normal_tail(z: Column) -> Column:
    """P(Z > z): the complementary error function by a rational approximation (error below 1.2e-7)."""
    # Coefficients of the approximation.
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x = F.abs(z) / math.sqrt(2)
    u = 1 / (1 + 0.5 * x)
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * u + c
    half = u * F.exp(-x * x + poly) / 2
    return F.when(z >= 0, half).otherwise(1 - half)
