"""Tail probabilities of the binomial and chi-square distributions, vectorised in numpy and offered as Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b), by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        out = front * h
    out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, out))
    return np.where(swap, 1 - out, out)


def upper_tail(k, n, p) -> np.ndarray:
    """P(X >= k) for X binomial (n, p)."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, beta_inc(np.maximum(k, 1), np.maximum(n - k + 1, 1), p)))


def lower_tail(k, n, p) -> np.ndarray:
    """P(X <= k) for X binomial (n, p)."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    return np.where(k >= n, 1.0, np.where(k < 0, 0.0, 1 - beta_inc(np.maximum(k + 1, 1), np.maximum(n - k, 1), p)))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi_square_sf(x: float, df: float) -> float:
    """P(X > x) for X chi-square with df degrees of freedom."""
    return gamma_q(df / 2, x / 2)


@F.pandas_udf(DoubleType())
def binomial_upper(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(upper_tail(k, n, p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def binomial_lower(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(lower_tail(k, n, p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi_square_sf(a, b) if a == a and b > 0 else None for a, b in zip(x, df)], dtype="float64")
