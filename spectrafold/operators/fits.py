"""Fits and tests of distributions and of broken lines.

Likelihoods are functions of sums.  Where the sums depend on a parameter (the
Weibull shape) each Newton step is one aggregation over counted values for all
groups at once.  Distances between distributions come from running counts by
ranges of values.  A broken line is found by dynamic programming over the moments
of a bounded number of bins, which are one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafold.functions.distributions import upper_gamma
from spectrafold.operators.cleaning import present
from spectrafold.operators.statistics import numbered
from spectrafold.session import cut_lineage

# Coefficients of the normal quantile (Wichura's rational approximations) by distance from the centre.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# Polynomials of the Shapiro-Wilk weights in 1/sqrt(n) and of the moments of its transformed statistic (Royston).
_LAST, _LAST_BUT_ONE = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN, _SMALL_SPREAD = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN, _LARGE_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda total, c: total * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def normal_quantile(p: Column) -> Column:
    """The standard normal's quantile of a probability between 0 and 1, as an expression."""
    q = p - 0.5
    ratio = lambda pair, x: _polynomial(pair[0], x) / _polynomial(pair[1], x)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    outer = F.when(r <= 5, ratio(_MIDDLE, r - 1.6)).otherwise(ratio(_TAIL, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(_CENTRE, F.lit(0.180625) - q * q)).when(q < 0, -outer).otherwise(outer)


def shapiro_wilk(df: DataFrame, column: str) -> DataFrame:
    """n, W and p of a test that values are normal; W and p are null with fewer than three values or without spread.

    Values are numbered by ranges, so that every value gets its weight from its
    rank alone; the weights' norm is a sum over the same rows. P-values are
    Royston's, meant for up to 5,000 values.
    """
    v = present(column).cast("double")
    ranked = numbered(df.where(v.isNotNull()).select(v.alias("v")), ["v"], "i")
    total = ranked.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    m = lambda i: normal_quantile((i - 0.375) / (F.col("n") + 0.25))
    scored = cut_lineage(ranked.crossJoin(F.broadcast(total)).withColumn("m", m(F.col("i"))))
    n = F.col("n").cast("double")
    # The two largest weights are corrected, the others scaled so that the squares still sum to one.
    shape = scored.agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.max("n").alias("n"))
    u, root = 1 / F.sqrt(n), F.sqrt("mm")
    last, second = m(n), m(n - 1)
    a_last = F.when(n == 3, math.sqrt(0.5)).otherwise(last / root + _polynomial(_LAST, u))
    a_second = second / root + _polynomial(_LAST_BUT_ONE, u)
    rest = F.when(n <= 5, (F.col("mm") - 2 * last * last) / (1 - 2 * a_last * a_last)).otherwise((F.col("mm") - 2 * last * last - 2 * second * second) / (1 - 2 * a_last * a_last - 2 * a_second * a_second))
    shape = shape.select(a_last.alias("a_last"), F.when(n > 5, a_second).alias("a_second"), F.sqrt(rest).alias("scale"))
    place = F.least(F.col("i"), F.col("n") - F.col("i") + 1)
    size = F.when(place == 1, F.col("a_last")).when((place == 2) & F.col("a_second").isNotNull(), F.col("a_second")).otherwise(F.abs("m") / F.col("scale"))
    weight = F.when(2 * F.col("i") == F.col("n") + 1, 0.0).otherwise(F.signum(F.col("m")) * size)
    sums = scored.crossJoin(F.broadcast(shape)).agg(F.count("*").alias("n"), F.sum(weight * (F.col("v") - F.col("mean"))).alias("b"), F.sum((F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("ss"))
    sums = sums.withColumn("w", F.when((F.col("n") >= 3) & (F.col("ss") > 0), F.least(F.lit(1.0), F.col("b") * F.col("b") / F.col("ss"))))
    log_n, gap = F.log(n), F.log1p(-F.col("w"))
    small = (-F.log(-2.273 + 0.459 * n - gap) - _polynomial(_SMALL_MEAN, n)) / F.exp(_polynomial(_SMALL_SPREAD, n))
    large = (gap - _polynomial(_LARGE_MEAN, log_n)) / F.exp(_polynomial(_LARGE_SPREAD, log_n))
    z = F.when(n <= 11, small).otherwise(large)
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    return sums.select("n", "w", F.when(n == 3, three).when(F.col("w") == 1.0, 1.0).otherwise(_normal_upper(z)).alias("p"))


@F.pandas_udf(T.DoubleType())
def _normal_upper(z: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2)) for v in z], dtype=float)


def _digamma(x: float, order: int = 0) -> float:
    """Derivative of log gamma, or with ``order`` 1 its derivative, by recurrence and asymptotic series."""
    total = 0.0
    while x < 12:
        total += 1 / (x * x) if order else -1 / x
        x += 1
    i = 1 / (x * x)
    if order:
        return total + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))
    return total + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


@F.pandas_udf(T.DoubleType())
def gamma_shape(log_mean: pd.Series, mean_log: pd.Series) -> pd.Series:
    """Newton's solution of log k - digamma(k) = log(mean) - mean(log)."""

    def solve(s: float) -> float | None:
        if not s > 0:
            return None
        k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
        for _ in range(50):
            step = (math.log(k) - _digamma(k) - s) / (1 / k - _digamma(k, 1))
            k = k - step if step < k else k / 2
            if abs(step) < 1e-14 * k:
                break
        return k

    return pd.Series([solve(a - b) for a, b in zip(log_mean, mean_log)], dtype=float)


def weibull_shapes(counted: DataFrame, sums: DataFrame, rounds: int = 40) -> DataFrame:
    """``(g, shape)`` by Newton steps over ``counted(g, v, n)``, from ``sums(g, n, mean_log, sd_log)``; values are taken relative to their geometric mean."""
    shapes = cut_lineage(sums.select("g", "mean_log", (F.lit(math.pi / math.sqrt(6)) / F.col("sd_log")).alias("shape")))
    z = F.log("v") - F.col("mean_log")
    power = F.col("n") * F.exp(F.col("shape") * z)
    for _ in range(rounds):
        each = counted.join(shapes, "g").groupBy("g").agg(F.max("mean_log").alias("mean_log"), F.max("shape").alias("shape"), F.sum(power).alias("s0"), F.sum(power * z).alias("s1"), F.sum(power * z * z).alias("s2"))
        ratio, k = F.col("s1") / F.col("s0"), F.col("shape")
        step = (ratio - 1 / k) / (F.col("s2") / F.col("s0") - ratio * ratio + 1 / (k * k))
        shapes = cut_lineage(each.select("g", "mean_log", F.when(step < k, k - step).otherwise(k / 2).alias("shape"), (F.abs(step) > 1e-12 * k).alias("moved")))
        if shapes.where("moved").isEmpty():
            break
        shapes = shapes.drop("moved")
    return shapes.select("g", "shape")


@F.pandas_udf(T.DoubleType())
def _distribution_function(kind: pd.Series, v: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    kind, v, a, b = kind.to_numpy(), v.to_numpy(float), a.to_numpy(float), b.to_numpy(float)
    out = np.empty(len(v))
    for name in np.unique(kind):
        at = kind == name
        x, p, q = v[at], a[at], b[at]
        if name in ("norm", "lognorm"):
            out[at] = [0.5 * math.erfc(-t / math.sqrt(2)) for t in ((np.log(x) if name == "lognorm" else x) - p) / q]
        elif name == "expon":
            out[at] = -np.expm1(-x / q)
        elif name == "weibull":
            out[at] = -np.expm1(-((x / q) ** p))
        else:
            out[at] = 1 - upper_gamma(p, x / q)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def kolmogorov_upper(d: pd.Series, n: pd.Series) -> pd.Series:
    """P of a larger distance, by the limit distribution with the usual correction for n."""

    def tail(t: float) -> float:
        if not t > 0.2:
            return 1.0
        return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * t * t) for j in range(1, 101))))

    return pd.Series([tail((math.sqrt(m) + 0.12 + 0.11 / math.sqrt(m)) * x) if m else None for x, m in zip(d, n)], dtype=float)


def fit_distributions(df: DataFrame, column: str, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """By group and distribution: maximum likelihood, AIC and the Kolmogorov-Smirnov distance with its p, and whether its AIC is the least.

    Positive values count, all distributions begin at 0.  ``shape`` and ``scale`` are
    mean and deviation (of the logarithms for ``lognorm``), the scale alone for
    ``expon``.  Groups of fewer than ``least`` values or without spread have no rows.
    """
    v = present(column).cast("double")
    counted = df.where((v > 0) & (v < float("inf"))).groupBy(F.struct(F.lit(0).alias("__none"), *by).alias("g"), v.alias("v")).agg(F.count("*").alias("n"))
    ranged = cut_lineage(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    n, log = F.col("n"), F.log("v")
    mean = lambda x: F.sum(n * x) / F.sum("n")
    sums = ranged.groupBy("g").agg(F.sum("n").alias("n"), mean(F.col("v")).alias("mean"), mean(log).alias("mean_log"))
    # Deviations around the means, in a second pass, so that nothing cancels.
    spread = ranged.select("g", "v", F.col("n").alias("c")).join(sums, "g").groupBy("g").agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("mean_log").alias("mean_log"),
        F.sqrt(F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), F.lit(2.0))) / F.max("n")).alias("sd"), F.sqrt(F.sum(F.col("c") * F.pow(log - F.col("mean_log"), F.lit(2.0))) / F.max("n")).alias("sd_log"),
    )
    sums = cut_lineage(spread.where((F.col("n") >= least) & (F.col("sd") > 0) & (F.col("sd_log") > 0)))
    shapes = weibull_shapes(ranged.select("g", "v", "n"), sums)
    scaled = ranged.select("g", "v", F.col("n").alias("c")).join(shapes, "g").join(sums.select("g", "mean_log"), "g")
    weibull = scaled.groupBy("g").agg(F.max("shape").alias("w_shape"), (F.exp(F.max("mean_log") + F.log(F.sum(F.col("c") * F.exp(F.col("shape") * (log - F.col("mean_log")))) / F.sum("c")) / F.max("shape"))).alias("w_scale"))
    told = sums.join(weibull, "g").withColumn("g_shape", gamma_shape(F.log("mean"), F.col("mean_log"))).withColumn("log_gamma", _log_gamma("g_shape"))
    logs, k, w = n * F.col("mean_log"), F.col("g_shape"), F.col("w_shape")
    normal = lambda sd: -n / 2 * (F.log(2 * math.pi * F.col(sd) * F.col(sd)) + 1)
    theta = F.col("mean") / k
    fits = [
        ("norm", 2, normal("sd"), F.col("mean"), F.col("sd")),
        ("lognorm", 2, normal("sd_log") - logs, F.col("mean_log"), F.col("sd_log")),
        ("expon", 1, -n * (F.log("mean") + 1), F.lit(1.0), F.col("mean")),
        ("gamma", 2, (k - 1) * logs - n * k - n * k * F.log(theta) - n * F.col("log_gamma"), k, theta),
        ("weibull", 2, n * F.log(w) - n * w * F.log("w_scale") + (w - 1) * logs - n, w, F.col("w_scale")),
    ]
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("distribution"), likely.alias("log_likelihood"), (2 * size - 2 * likely).alias("aic"), a.alias("shape"), b.alias("scale")) for name, size, likely, a, b in fits]))
    told = cut_lineage(told.select("g", "n", rows))
    # How far the share of values up to each one lies from the distribution, before and after its step.
    parts = ranged.groupBy("g", "part").agg(F.sum("n").alias("size"))
    before = parts.select("g", "part", (F.sum("size").over(W.partitionBy("g").orderBy("part")) - F.col("size")).alias("before"))
    upto = ranged.withColumn("inner", F.sum("n").over(W.partitionBy("g", "part").orderBy("v"))).join(before, ["g", "part"]).select("g", "v", F.col("n").alias("c"), (F.col("inner") + F.col("before")).alias("upto"))
    at = upto.join(told, "g").withColumn("f", _distribution_function("distribution", "v", "shape", "scale"))
    far = at.groupBy("g", "distribution").agg(F.max(F.greatest(F.col("upto") / n - F.col("f"), F.col("f") - (F.col("upto") - F.col("c")) / n)).alias("ks"))
    out = told.join(far, ["g", "distribution"])
    best = told.groupBy("g").agg(F.min(F.struct("aic", "distribution")).alias("best"))
    out = out.join(best, "g").withColumn("ks_p", kolmogorov_upper("ks", F.col("n").cast("double")))
    return out.select("g.*", "distribution", "n", "shape", "scale", "log_likelihood", "aic", "ks", "ks_p", (F.col("best.distribution") == F.col("distribution")).alias("best")).drop("__none")


@F.pandas_udf(T.DoubleType())
def _log_gamma(x: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else math.lgamma(v) for v in x], dtype=float)


def _segments(moments: np.ndarray, count: int, least: float) -> list[tuple[int, int]]:
    """Cuts of rows of (n, x, y, xx, xy, yy) into ``count`` runs of least squared error around a line each."""
    size = len(moments)
    total = np.vstack([np.zeros(6), np.cumsum(moments, axis=0)])

    def error(a: int, b: int) -> float:
        n, sx, sy, sxx, sxy, syy = total[b] - total[a]
        if n < least:
            return math.inf
        vx, vy, c = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        return max(0.0, vy - c * c / vx) if vx > 1e-12 * max(1.0, abs(sxx)) else max(0.0, vy)

    cost = np.full((count + 1, size + 1), math.inf)
    back = np.zeros((count + 1, size + 1), dtype=int)
    cost[0, 0] = 0.0
    errors = {(a, b): error(a, b) for a in range(size) for b in range(a + 1, size + 1)}
    for k in range(1, count + 1):
        for b in range(1, size + 1):
            for a in range(b):
                if cost[k - 1, a] + errors[a, b] < cost[k, b]:
                    cost[k, b], back[k, b] = cost[k - 1, a] + errors[a, b], a
    if not math.isfinite(cost[count, size]):
        return []
    cuts, b = [], size
    for k in range(count, 0, -1):
        a = int(back[k, b])
        cuts.append((a, b))
        b = a
    return cuts[::-1]


def broken_line(df: DataFrame, x: str, y: str, breaks: int, bins: int = 64, least: int = 3) -> DataFrame:
    """Lines of a regression with ``breaks`` free breakpoints: segment, from_x, to_x, n, slope, intercept and the r_squared of the whole.

    x is cut into bins of equal width between its ends; a breakpoint is the edge
    of a bin, and each segment, of at least ``least`` rows, has a line of its own that need
    not meet its neighbour's.  The choice is the best of all, by dynamic programming over the bins.
    No rows come back where the data can't be cut so.
    """
    some = df.select(present(x).cast("double").alias("x"), present(y).cast("double").alias("y")).dropna()
    ends = some.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int"))).otherwise(0)
    wide = some.crossJoin(F.broadcast(ends)).withColumn("bin", place)
    # Moments around the means keep their digits.
    a, b = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    binned = wide.groupBy("bin").agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"), F.max("mx").alias("mx"), F.max("my").alias("my"), F.max("low").alias("low"), F.max("high").alias("high"))

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        m = part[["n", "sx", "sy", "sxx", "sxy", "syy"]].to_numpy(float)
        mx, my, low, high = part[["mx", "my", "low", "high"]].iloc[0]
        edge = lambda i: float(low + (high - low) * i / bins)
        at = part["bin"].to_numpy()
        rows, left = [], 0.0
        for k, (i, j) in enumerate(_segments(m, breaks + 1, least)):
            n, sx, sy, sxx, sxy, syy = m[i:j].sum(axis=0)
            vx, vy, c = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
            slope = c / vx if vx > 1e-12 * max(1.0, abs(sxx)) else 0.0
            left += max(0.0, vy - slope * c)
            rows.append([k + 1, edge(at[i]) if k else float(low), float(high) if j == len(at) else edge(at[j]), int(n), slope, my + (sy - slope * sx) / n - slope * mx])
        whole = m[:, 5].sum() - m[:, 2].sum() ** 2 / m[:, 0].sum()
        fit = 1 - left / whole if whole > 0 else None
        return pd.DataFrame([[*r, fit] for r in rows], columns=["segment", "from_x", "to_x", "n", "slope", "intercept", "r_squared"])

    # At most ``bins`` rows meet.
    return binned.groupBy().applyInPandas(cut, "segment int, from_x double, to_x double, n long, slope double, intercept double, r_squared double")
