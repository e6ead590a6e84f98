"""Distribution functions of the normal, t, chi-squared and F laws in plain Python; for the few rows that tests end with."""

from __future__ import annotations

import math
from statistics import NormalDist

_EPS, _TINY, _STEPS = 3e-16, 1e-300, 10_000


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(_STEPS):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = 1 + step / c
        c = c if abs(c) > _TINY else _TINY
        f *= c * d
        if abs(1 - c * d) < _EPS:
            break
    return front * (f - 1)


def gamma_inc(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, _STEPS):
            term *= x / (a + n)
            total += term
            if term < total * _EPS:
                break
        return total * front
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, _STEPS):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < _EPS:
            break
    return 1 - front * h


def t_cdf(x: float, dof: float) -> float:
    tail = 0.5 * beta_inc(dof / 2, 0.5, dof / (dof + x * x))
    return 1 - tail if x > 0 else tail


def t_two_sided(x: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + x * x))


def chi2_tail(x: float, dof: float) -> float:
    return 1 - gamma_inc(dof / 2, x / 2)


def f_tail(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def _inverse(cdf, p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        low, high = high, high * 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
        if high - low <= 1e-14 * max(1.0, abs(high)):
            break
    return (low + high) / 2


def t_ppf(p: float, dof: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, dof)
    return _inverse(lambda x: t_cdf(x, dof), p, 0.0, 1.0)


def chi2_ppf(p: float, dof: float) -> float:
    return _inverse(lambda x: 1 - chi2_tail(x, dof), p, 0.0, 1.0)


def f_ppf(p: float, d1: float, d2: float) -> float:
    return _inverse(lambda x: 1 - f_tail(x, d1, d2), p, 0.0, 1.0)
