"""Quantiles, normality, fits and broken lines against direct computation and published values."""

import math
import random
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from spectrafold.operators import fits as f


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749999, 0.075, 0.3, 0.5, 0.9, 0.925, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", f.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(math.isclose(r.z, NormalDist().inv_cdf(r.p), rel_tol=1e-12, abs_tol=1e-14) for r in got)


def test_shapiro_wilk_reference_rows(spark):
    """Statistics and p-values published for these samples."""
    rows = [
        ([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66], 0.90047299861907959, 0.042089745402336121),
        ([1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49], 0.9590270, 0.52460),
        ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704),
    ]
    for values, w, p in rows:
        got = f.shapiro_wilk(spark.createDataFrame([(float(v),) for v in [*values, float("nan")]], "v double").repartition(3), "v").first()
        assert got.n == len(values) and math.isclose(got.w, w, abs_tol=1e-5) and math.isclose(got.p, p, abs_tol=1e-5)
    first = f.shapiro_wilk(spark.createDataFrame([(float(v),) for v in rows[0][0]], "v double"), "v").first()
    assert math.isclose(first.w, rows[0][1], abs_tol=1e-6) and math.isclose(first.p, rows[0][2], abs_tol=1e-6)


def test_shapiro_wilk_edges(spark):
    few = lambda vs: f.shapiro_wilk(spark.createDataFrame([(v,) for v in vs], "v double"), "v").first()
    assert (few([]).n, few([]).w, few([1.0, 2.0]).w, few([3.0] * 9).w) == (0, None, None, None)
    three = few([1.0, 2.0, 3.0])
    assert math.isclose(three.w, 1.0) and math.isclose(three.p, 1.0, abs_tol=1e-6)
    assert few([1.0, 2.0, 4.0, 9.0, 30.0]).w < few([1.0, 2.0, 3.0, 4.0, 5.0]).w <= 1.0


def test_fits_meet_their_equations(spark):
    draw = random.Random(3)
    groups = {"g": [draw.gammavariate(2.5, 3.0) for _ in range(400)], "w": [round(draw.weibullvariate(5.0, 1.7), 2) + 0.01 for _ in range(400)], "few": [1.0, 2.0], "flat": [4.0] * 30}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("g", -1.0), ("g", None), ("g", float("nan"))]
    got = f.fit_distributions(spark.createDataFrame(rows, "k string, v double").repartition(4), "v", ["k"]).collect()
    assert {(r.k, r.distribution) for r in got} == {(k, d) for k in "gw" for d in ("norm", "lognorm", "expon", "gamma", "weibull")}
    by = {(r.k, r.distribution): r for r in got}
    for k in "gw":
        x = np.sort(np.array(groups[k]))
        n, logs = len(x), np.log(x)
        gamma, weibull = by[k, "gamma"], by[k, "weibull"]
        slope = lambda h, p: (math.lgamma(p + h) - math.lgamma(p - h)) / (2 * h)
        assert math.isclose(math.log(gamma.shape) - slope(1e-5, gamma.shape), math.log(x.mean()) - logs.mean(), rel_tol=1e-6) and math.isclose(gamma.shape * gamma.scale, x.mean(), rel_tol=1e-9)
        power = x**weibull.shape
        assert math.isclose((power * logs).sum() / power.sum() - 1 / weibull.shape, logs.mean(), rel_tol=1e-8) and math.isclose(weibull.scale, power.mean() ** (1 / weibull.shape), rel_tol=1e-9)
        density = {
            "gamma": (gamma.shape - 1) * logs - x / gamma.scale - gamma.shape * math.log(gamma.scale) - math.lgamma(gamma.shape),
            "weibull": math.log(weibull.shape / weibull.scale) + (weibull.shape - 1) * np.log(x / weibull.scale) - (x / weibull.scale) ** weibull.shape,
            "norm": -0.5 * math.log(2 * math.pi * x.var()) - (x - x.mean()) ** 2 / (2 * x.var()),
            "lognorm": -logs - 0.5 * math.log(2 * math.pi * logs.var()) - (logs - logs.mean()) ** 2 / (2 * logs.var()),
            "expon": -math.log(x.mean()) - x / x.mean(),
        }
        for d, values in density.items():
            assert math.isclose(by[k, d].log_likelihood, values.sum(), rel_tol=1e-9), d
            assert by[k, d].best == (by[k, d].aic == min(by[k, e].aic for e in density))
        cdf = {"norm": [NormalDist(x.mean(), x.std()).cdf(v) for v in x], "expon": 1 - np.exp(-x / x.mean()), "weibull": 1 - np.exp(-((x / weibull.scale) ** weibull.shape))}
        for d, p in cdf.items():
            p = np.array(p)
            want = max(max(np.searchsorted(x, v, "right") / n - q, q - np.searchsorted(x, v, "left") / n) for v, q in zip(x, p))
            assert math.isclose(by[k, d].ks, want, rel_tol=1e-9), d
        mass = np.linspace(0, 1, 200001)[1:] * x.max() * 1.0
        pdf = np.exp((gamma.shape - 1) * np.log(mass) - mass / gamma.scale - gamma.shape * math.log(gamma.scale) - math.lgamma(gamma.shape))
        area = np.r_[0, np.cumsum((pdf[1:] + pdf[:-1]) / 2 * np.diff(mass))]
        p = np.interp(x, mass, area)
        want = max(max(np.searchsorted(x, v, "right") / n - q, q - np.searchsorted(x, v, "left") / n) for v, q in zip(x, p))
        assert math.isclose(by[k, "gamma"].ks, want, abs_tol=1e-4)
    assert by["g", "gamma"].ks_p > 0.01 and by["g", "expon"].ks_p < 0.01 and by["g", "gamma"].best


def test_kolmogorov_upper(spark):
    got = spark.createDataFrame([(1.3581 / math.sqrt(1e8), 1e8), (0.0, 10.0), (0.9, 100.0)], "d double, n double").select(f.kolmogorov_upper("d", "n").alias("p")).collect()
    assert math.isclose(got[0].p, 0.05, abs_tol=1e-4) and got[1].p == 1.0 and got[2].p < 1e-12


def line_error(x, y):
    if len(x) < 3:
        return math.inf
    vx = ((x - x.mean()) ** 2).sum()
    c = ((x - x.mean()) * (y - y.mean())).sum()
    return ((y - y.mean()) ** 2).sum() - (c * c / vx if vx > 1e-12 else 0)


def test_broken_line_is_the_best_cut(spark):
    draw = random.Random(4)
    xs = [draw.random() * 12 for _ in range(200)]
    ys = [(2 * x if x < 4 else 8 - 3 * (x - 4) if x < 8 else -4 + 0.5 * (x - 8)) + draw.gauss(0, 0.2) for x in xs]
    df = spark.createDataFrame([*zip(xs, ys), (None, 1.0), (2.0, float("nan"))], "x double, y double")
    x, y = np.array(xs), np.array(ys)
    for breaks, bins in ((0, 8), (1, 12), (2, 12)):
        got = f.broken_line(df.repartition(3), "x", "y", breaks, bins).orderBy("segment").collect()
        at = np.minimum(bins - 1, np.floor((x - x.min()) / (x.max() - x.min()) * bins)).astype(int)
        best = min(sum(line_error(x[(at >= a) & (at < b)], y[(at >= a) & (at < b)]) for a, b in zip((0, *cut), (*cut, bins))) for cut in combinations(range(1, bins), breaks))
        assert len(got) == breaks + 1 and sum(r.n for r in got) == 200
        assert math.isclose(got[0].r_squared, 1 - best / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    assert [round(r.slope) for r in got[:2]] == [2, -3] and abs(got[1].from_x - 4) < 0.6
    assert f.broken_line(df, "x", "y", 3, 3).count() == 0 and f.broken_line(df.limit(0), "x", "y", 1).count() == 0
