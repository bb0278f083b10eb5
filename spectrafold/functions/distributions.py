"""Tail probabilities of the usual test distributions, vectorised for Arrow batches.

They run on result rows of tests, a handful per test, through Pandas UDFs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_log_gamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by forward recurrence of ratios."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    c = np.ones_like(x)
    out = d.copy()
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + term * d)
            c = guard(1 + term / c)
            out = out * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    value = np.where(low, front * _beta_fraction(a, b, np.where(low, inner, 0.0)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.0, 1 - inner)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def upper_gamma(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.ones_like(x)
    for i in np.ndindex(x.shape):
        s, v = float(a[i]), float(x[i])
        if v <= 0:
            continue
        front = math.exp(s * math.log(v) - v - math.lgamma(s))
        if v < s + 1:
            term = total = 1 / s
            k = s
            while abs(term) > 1e-16 * abs(total):
                k += 1
                term *= v / k
                total += term
            out[i] = 1 - front * total
        else:
            b = v + 1 - s
            c, d = 1e300, 1 / b
            h = d
            for k in range(1, 1000):
                an = -k * (k - s)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = front * h
    return out


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|)."""
    return pd.Series(incomplete_beta(df / 2, 0.5, df / (df + t * t)))


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F >= f)."""
    return pd.Series(incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X >= x)."""
    return pd.Series(upper_gamma(df / 2, x / 2))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|)."""
    return pd.Series(_erfc(np.abs(z) / math.sqrt(2)))
