"""Rows needed by tests whose power follows a noncentral F or chi-squared distribution.

Designs are rows of a small table; each is solved by bisection on the number of
rows, whose power is a Poisson mixture of central tails.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafold.functions.distributions import incomplete_beta, upper_gamma

MOST_ROWS = 10**9


def _mixture(nc: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a Poisson distribution of mean nc / 2, as far as they count."""
    mean = nc / 2
    reach = 12 * math.sqrt(mean) + 30
    j = np.arange(max(0, math.floor(mean - reach)), math.ceil(mean + reach) + 1)
    return j, np.exp(-mean + j * math.log(mean) - np.array([math.lgamma(k + 1) for k in j])) if mean > 0 else (j == 0).astype(float)


def _bisect(f: Callable[[float], float], low: float, high: float, close: float = 1e-12) -> float:
    """The place where a rising function passes zero, to a relative ``close``."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
        if high - low <= close * max(1.0, high):
            break
    return high


def f_power(d1: float, d2: float, nc: float, alpha: float) -> float:
    """Power of an F test with the noncentrality ``nc``."""
    share = _bisect(lambda s: float(incomplete_beta(d1 / 2, d2 / 2, s)) - (1 - alpha), 0.0, 1.0)
    j, w = _mixture(nc)
    return float(1 - (w * incomplete_beta(d1 / 2 + j, d2 / 2, share)).sum())


def chi2_power(df: float, nc: float, alpha: float) -> float:
    """Power of a chi-squared test with the noncentrality ``nc``."""
    x = _bisect(lambda v: alpha - float(upper_gamma(df / 2, v / 2)), 0.0, 50 + 10 * df)
    j, w = _mixture(nc)
    return float((w * upper_gamma(df / 2 + j, np.full(len(j), x / 2))).sum())


def _least_rows(power_of: Callable[[float], float], power: float, start: float) -> float | None:
    high = start
    while power_of(high) < power:
        high *= 2
        if high > MOST_ROWS:
            return None
    return _bisect(lambda n: power_of(n) - power, max(start, high / 2), high, 1e-9)


def _solver(solve: Callable[[float, float, float, float], float | None]):
    @F.pandas_udf(T.LongType())
    def rows(effect: pd.Series, size: pd.Series, power: pd.Series, alpha: pd.Series) -> pd.Series:
        out = []
        for e, k, p, a in zip(effect, size, power, alpha):
            good = e == e and k == k and e and k and k >= 1 and 0 < a < p < 1
            out.append(solve(abs(float(e)), float(k), p, a) if good else None)
        return pd.Series(out, dtype="Int64")

    return rows


def _ceil(n: float | None) -> int | None:
    return None if n is None else math.ceil(n - 1e-9)


def anova_rows(designs: DataFrame, effect: str, groups: str, power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """``n_per_group`` for a one-way analysis of variance of effect f over k groups (at least two)."""

    def solve(f: float, k: float, power: float, alpha: float) -> int | None:
        return None if k < 2 else _ceil(n / k if (n := _least_rows(lambda n: f_power(k - 1, n - k, f * f * n, alpha), power, k + 1.0)) else None)

    return designs.withColumn("n_per_group", _solver(solve)(F.col(effect).cast("double"), F.col(groups).cast("double"), F.lit(power), F.lit(alpha)))


def regression_rows(designs: DataFrame, effect: str, predictors: str, power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """``n_rows`` for a regression on p predictors of the effect f² (of the whole model, noncentrality f² n)."""

    def solve(f2: float, p: float, power: float, alpha: float) -> int | None:
        return _ceil(_least_rows(lambda n: f_power(p, n - p - 1, f2 * n, alpha), power, p + 2.0))

    return designs.withColumn("n_rows", _solver(solve)(F.col(effect).cast("double"), F.col(predictors).cast("double"), F.lit(power), F.lit(alpha)))


def chi2_rows(designs: DataFrame, effect: str, dof: str, power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """``n_rows`` for a chi-squared test of the effect w."""

    def solve(w: float, df: float, power: float, alpha: float) -> int | None:
        return _ceil(_least_rows(lambda n: chi2_power(df, w * w * n, alpha), power, 1.0))

    return designs.withColumn("n_rows", _solver(solve)(F.col(effect).cast("double"), F.col(dof).cast("double"), F.lit(power), F.lit(alpha)))
