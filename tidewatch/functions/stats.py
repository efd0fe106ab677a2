"""Distribution tails for p-values (no scipy in the environment).

Pure-Python numerics from textbook series / continued fractions, wrapped as
Arrow-batched pandas UDFs. Statistics themselves are computed in Spark SQL;
these only map a statistic to a probability.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _gser(a: float, x: float) -> float:
    """Regularized lower incomplete gamma P(a, x) by series."""
    term = total = 1.0 / a
    ap = a
    for _ in range(10_000):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gcf(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x) by continued fraction."""
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    if x is None or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    a, h = df / 2.0, x / 2.0
    return 1.0 - _gser(a, h) if h < a + 1.0 else _gcf(a, h)


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def shapiro_p(w: float, n: int) -> float:
    """Royston (1995) normal approximation of the Shapiro-Wilk W tail."""
    if n < 3 or w is None or math.isnan(w):
        return float("nan")
    if n == 3:
        return max(0.0, min(1.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    y = math.log(1.0 - w)
    ln = math.log(n)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        mu = 0.5440 - 0.39978 * n + 0.025054 * n ** 2 - 0.0006714 * n ** 3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n ** 2 - 0.0020322 * n ** 3)
        if y >= gamma:
            return 0.0
        y = -math.log(gamma - y)
    else:
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln ** 2 + 0.0038915 * ln ** 3
        sigma = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln ** 2)
    return normal_sf((y - mu) / sigma)


def inv_norm(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _vectorize(fn, n_args):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*(None if pd.isna(v) else float(v) for v in vals)) if all(
            not pd.isna(v) for v in vals) else float("nan") for vals in zip(*cols)], dtype="float64")
    return F.pandas_udf(run, DoubleType())


chi2_sf_udf = _vectorize(chi2_sf, 2)
t_p_udf = _vectorize(t_two_sided_p, 2)
normal_sf_udf = _vectorize(normal_sf, 1)
shapiro_p_udf = _vectorize(lambda w, n: shapiro_p(w, int(n)), 2)
inv_norm_udf = _vectorize(inv_norm, 1)
