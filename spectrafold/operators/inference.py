"""Correlation, intervals, exact tests, fits, power and resampling.

Statistics are grouped aggregations; closed forms and tail probabilities are
applied to the few result rows.  Resampling draws by hashes of the row's id and
the draw's number, so results don't depend on how the data is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafold.functions.distributions import incomplete_beta
from spectrafold.operators.cleaning import present
from spectrafold.operators.statistics import linear_fit, mid_ranks, numbered, quantiles, with_p


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation over rows that have both, ties with their mean rank."""
    both = df.select(present(x).cast("double").alias("x"), present(y).cast("double").alias("y")).dropna()
    ranked = mid_ranks(mid_ranks(both, "x", "rx").drop("ties"), "y", "ry")
    return with_p(linear_fit(ranked, "rx", "ry").select("n", "r"), "r")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """r and p of every pair of columns over the rows that have both, in one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), present(F.col(a).cast("double")).alias("x"), present(F.col(b).cast("double")).alias("y")) for a, b in combinations(columns, 2)]))
    return with_p(linear_fit(df.select(pairs.alias("c")).select("c.*"), "x", "y", ["first", "second"]).select("first", "second", "n", "r"), "r")


def guarded_correlation(df: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """r over finite pairs; neutral with fewer than ``least`` of them."""
    finite = lambda c: present(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    out = df.where(finite(x) & finite(y)).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    return out.select("n", F.when(F.col("n") >= least, F.col("r")).otherwise(0.0).alias("r"))


def residual_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean, population deviation and range of what a least-squares line leaves."""
    fit = linear_fit(df, x, y).select("slope", "intercept", "r_squared")
    e = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    return df.crossJoin(F.broadcast(fit)).agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.max("r_squared").alias("r_squared"), F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"), F.min(e).alias("residual_min"), F.max(e).alias("residual_max"))


def t_quantile(p: float, df: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        tail = 0.5 * float(incomplete_beta(df / 2, 0.5, df / (df + mid * mid)))
        low, high = (mid, high) if 1 - tail < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) if b > 0 else None for a, b in zip(p, df)])


def mean_interval(df: DataFrame, column: str, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Mean with its t interval."""
    v = present(column).cast("double")
    m = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("s"))
    half = t_critical(F.lit(0.5 + confidence / 2), (F.col("n") - 1).cast("double")) * F.col("s") / F.sqrt("n")
    return m.withColumn("half", half).select(*by, "n", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


#: Draws in one pass over the rows.
DRAWS = 25


def bootstrap_means(df: DataFrame, id_col: str, column: str, draws: int) -> DataFrame:
    """``(draw, mean)`` of Poisson bootstraps: a row's weight in a draw follows from a hash of its id and the draw's number."""
    bounds, mass, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += mass
        mass /= k + 1
        bounds.append(total)
    # Every draw is a column of one aggregation, in runs of draws: rows are never multiplied.
    each = df.select(F.col(id_col).cast("string").alias("id"), F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    out = None
    for first in range(1, draws + 1, DRAWS):
        told = []
        for draw in range(first, min(draws, first + DRAWS - 1) + 1):
            u = F.conv(F.substring(F.md5(F.concat(F.col("id"), F.lit(f":{draw}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
            w = F.transform(F.array(u), lambda u: sum(((u >= t).cast("int") for t in bounds), F.lit(0)))[0]
            told.append(F.struct(F.lit(draw).alias("draw"), (F.sum(w * F.col("v")) / F.sum(w)).alias("mean")))
        part = each.agg(F.array(*told).alias("d")).select(F.inline("d"))
        out = part if out is None else out.unionByName(part)
    return out


def bootstrap_interval(df: DataFrame, id_col: str, column: str, draws: int = 200, confidence: float = 0.95) -> DataFrame:
    ends = quantiles(bootstrap_means(df, id_col, column, draws), "mean", ((1 - confidence) / 2, (1 + confidence) / 2))
    return ends.select(F.col("q0").alias("low"), F.col("q1").alias("high"))


def _hypergeometric_tail(a: float, b: float, c: float, d: float, block: int = 1 << 16) -> float:
    """P of at least ``a``, summed from ``a`` on by the ratio of neighbouring terms until they no longer count."""
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    term, total, k, last = choose(row, a) + choose(n - row, c) - choose(n, col), 0.0, a, min(row, col)
    while True:
        total += math.exp(term)
        step = np.arange(k, min(k + block, last))
        if not len(step):
            return min(1.0, total)
        terms = term + np.cumsum(np.log((row - step) * (col - step)) - np.log((step + 1) * (n - row - col + step + 1)))
        total += float(np.exp(terms[:-1]).sum())
        k, term = step[-1] + 1, float(terms[-1])
        if len(terms) > 1 and terms[-1] < terms[-2] and math.exp(term) < 1e-18 * total:
            return min(1.0, total)


def fisher_greater(table: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """P of at least ``a`` shared members in a 2 x 2 table with fixed margins, as ``p`` beside the odds ratio."""
    @F.pandas_udf(T.DoubleType())
    def tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_hypergeometric_tail(*cells) for cells in zip(a, b, c, d)], dtype=float)

    odds = F.try_divide(F.col(a) * F.col(d), F.col(b) * F.col(c))
    return table.withColumn("odds_ratio", odds).withColumn("p", tail(*[F.col(x).cast("double") for x in (a, b, c, d)]))


def overlap_table(universe: DataFrame, key: str, first: Column, second: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts of members of both sets, of either, and of none."""
    one, two = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return universe.groupBy(*by).agg(F.count_if(one & two).alias("both"), F.count_if(one & ~two).alias("first_only"), F.count_if(~one & two).alias("second_only"), F.count_if(~one & ~two).alias("neither"))


def distribution_fits(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Maximum likelihood of normal, log-normal and exponential distributions with AIC, best first by group."""
    v = F.when(present(column) > 0, present(column).cast("double"))
    m = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mu"), F.var_pop(v).alias("s2"), F.avg(F.log(v)).alias("lmu"), F.var_pop(F.log(v)).alias("ls2"), F.sum(F.log(v)).alias("slog"))
    log = lambda c: -F.col("n") / 2 * (F.log(F.lit(2 * math.pi) * F.col(c)) + 1)
    fits = [("norm", 2, log("s2"), F.col("mu"), F.sqrt("s2")), ("lognorm", 2, log("ls2") - F.col("slog"), F.col("lmu"), F.sqrt("ls2")), ("expon", 1, -F.col("n") * (F.log("mu") + 1), F.col("mu"), F.lit(None).cast("double"))]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("distribution"), ll.alias("log_likelihood"), (2 * k - 2 * ll).alias("aic"), a.alias("location"), b.alias("scale")) for n, k, ll, a, b in fits]))
    return m.where("n >= 10 AND s2 > 0").select(*by, "n", rows.alias("f")).select(*by, "n", "f.*")


def segmented_fit(df: DataFrame, x: str, y: str, breaks: Sequence[float]) -> DataFrame:
    """Two least-squares lines with the breakpoint, of those given, of least squared error."""
    some = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.explode(F.array(*[F.lit(float(b)) for b in breaks])).alias("at")).withColumn("right", F.col("x") > F.col("at"))
    side = linear_fit(some, "x", "y", ["at", "right"])
    spread = some.groupBy("at", "right").agg((F.var_pop("y") * F.count("*")).alias("ss"))
    sides = side.join(spread, ["at", "right"]).withColumn("sse", F.col("ss") * (1 - F.coalesce("r_squared", F.lit(0.0))))
    whole = sides.groupBy("at").agg(F.count("*").alias("k"), F.sum("sse").alias("sse"), F.max(F.when(~F.col("right"), F.col("slope"))).alias("left_slope"), F.max(F.when(F.col("right"), F.col("slope"))).alias("right_slope")).where("k = 2")
    return whole.agg(F.min(F.struct("sse", "at", "left_slope", "right_slope")).alias("b")).select("b.at", "b.sse", "b.left_slope", "b.right_slope")


def effect_label(size: Column, measure: str = "cohens_d") -> Column:
    """Small, medium or large by the usual cut-offs of each measure."""
    small, medium, large = {"cohens_d": (0.2, 0.5, 0.8), "eta_squared": (0.01, 0.06, 0.14), "cramers_v": (0.1, 0.3, 0.5), "r": (0.1, 0.3, 0.5)}[measure]
    s = F.abs(size)
    return F.when(s < small, "negligible").when(s < medium, "small").when(s < large, "medium").otherwise("large")


def assumption_warnings(df: DataFrame, group: str, measure: str) -> DataFrame:
    """By group: too few rows, or a skew or kurtosis far from that of a normal sample."""
    m = df.groupBy(group).agg(F.count(measure).alias("n"), F.skewness(measure).alias("skew"), F.kurtosis(measure).alias("kurt"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return m.select(group, "n", jb.alias("jarque_bera"), F.array_join(F.array_compact(F.array(F.when(F.col("n") < 30, F.lit("few rows")), F.when(jb > 5.991464547, F.lit("not normal")))), ";").alias("warnings"))


def _z(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sample_sizes(effects: DataFrame, effect: str, power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """Rows needed: per group for a t-test, in all for a correlation, by normal approximation and Fisher's z."""
    reach = _z(1 - alpha / 2) + _z(power)
    d = F.abs(F.col(effect))
    z = 0.5 * F.log((1 + d) / (1 - d))
    return effects.withColumn("n_t", F.when(d > 0, F.ceil(2 * reach**2 / (d * d)).cast("long"))).withColumn("n_r", F.when((d > 0) & (d < 1), F.ceil((reach / z) * (reach / z) + 3).cast("long")))


def test_power(groups: DataFrame, effect: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Power of a two-sided t-test with ``n`` rows a group, by normal approximation."""
    x = F.abs(F.col(effect)) * F.sqrt(F.col(n) / 2) - _z(1 - alpha / 2)
    # The normal distribution function by its series to 1e-7 (Abramowitz and Stegun 26.2.17).
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return groups.withColumn("power", F.when(x >= 0, 1 - tail).otherwise(tail))


test_power.__test__ = False


def confidence_fold(df: DataFrame, key: str, order: str, support: Column, weight: str, start: float = 0.5) -> DataFrame:
    """By key, a confidence moved up or down by each result in order: towards 1 or 0 by 0.3 of its weight.

    Steps are folded as a sorted partition is read, so a key of any number of
    steps needs the memory of one batch.
    """
    kind = df.schema[key].dataType.simpleString()

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, shown, n, c = None, None, 0, start
        for part in parts:
            out = []
            for k, v, support, w in zip(part["k"], part["v"], part["s"], part["w"]):
                if k != now:
                    if n:
                        out.append((shown, n, c))
                    now, shown, n, c = k, v, 0, start
                n += 1
                c = c + (1 - c) * w * 0.3 if support is not None and support else c * (1 - w * 0.3)
            yield pd.DataFrame(out, columns=["v", "n", "c"])
        if n:
            yield pd.DataFrame([(shown, n, c)], columns=["v", "n", "c"])

    rows = df.select(F.col(key).alias("v"), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"), F.col(order).alias("o"), support.alias("s"), F.col(weight).cast("double").alias("w"))
    told = rows.repartition("k").sortWithinPartitions("k", "o", "s", "w").select("v", "k", "s", "w").mapInPandas(fold, f"v {kind}, n int, c double")
    return told.select(F.col("v").alias(key), "n", F.col("c").alias("confidence"))


def shuffled(df: DataFrame, id_col: str, columns: Sequence[str], seed: str = "0") -> DataFrame:
    """The chosen columns dealt anew over the rows, each by an order of its own; the other columns stay."""
    out = numbered(df, [id_col], "__at")
    for c in columns:
        mixed = numbered(df.select(F.col(c).alias("__v"), F.md5(F.concat_ws(":", F.lit(f"{seed}:{c}"), F.col(id_col).cast("string"))).alias("__h")), ["__h"], "__to")
        out = out.join(mixed.select("__v", "__to"), F.col("__at") == F.col("__to")).drop("__to", c).withColumnRenamed("__v", c)
    return out.drop("__at").select(*df.columns)


def null_summary(draws: DataFrame, value: str, observed: Column) -> DataFrame:
    """Quantiles of a null distribution and the two-sided share of it as far out as what was observed."""
    p = (F.count_if(F.abs(F.col(value)) >= F.abs(observed)) + 1) / (F.count("*") + 1)
    return draws.agg(F.count("*").alias("draws"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), p.alias("p")).crossJoin(quantiles(draws, value, (0.05, 0.5, 0.95)))


def group_split(df: DataFrame, group: str, share: float, salt: str = "split") -> DataFrame:
    """``test`` for about a share of the groups; all rows of a group go the same way."""
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col(group).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(unit < share, "test").otherwise("train"))


def three_way_split(df: DataFrame, id_col: str, test: float, validation: float) -> DataFrame:
    """``test``, then ``validation``, then ``train``, by place in hash order."""
    placed = numbered(df.withColumn("__h", F.md5(F.col(id_col).cast("string"))), ["__h"], "__p")
    placed = placed.crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    at = F.col("__p") / F.col("__n")
    return placed.withColumn("split", F.when(at <= test, "test").when(at <= test + validation, "validation").otherwise("train")).drop("__h", "__p", "__n")


def folds(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """``fold`` 0 to k - 1 by hash of the id."""
    return df.withColumn("fold", (F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % k).cast("int"))


def fold_scores(df: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """Of each fold, the error of a line fitted to the other folds.

    Moments are additive, so each fold's training moments are the total less its
    own, and every fold is fitted from one pass.
    """
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    own = df.groupBy(fold).agg(F.count("*").alias("n"), F.sum(x_).alias("sx"), F.sum(y_).alias("sy"), F.sum(x_ * x_).alias("sxx"), F.sum(x_ * y_).alias("sxy"), F.sum(y_ * y_).alias("syy"))
    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    wide = own.crossJoin(F.broadcast(own.agg(*[F.sum(c).alias(f"t_{c}") for c in names])))
    n, sx, sy, sxx, sxy = (F.col(f"t_{c}") - F.col(c) for c in names[:5])
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    wide = wide.withColumn("slope", slope).withColumn("intercept", (sy - F.col("slope") * sx) / n)
    s, i = F.col("slope"), F.col("intercept")
    sse = F.col("syy") - 2 * s * F.col("sxy") - 2 * i * F.col("sy") + s * s * F.col("sxx") + 2 * s * i * F.col("sx") + F.col("n") * i * i
    return wide.select(fold, "n", "slope", "intercept", (sse / F.col("n")).alias("mse"))


def out_of_fold(df: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """Each row predicted by the line of the folds it is not in."""
    lines = fold_scores(df, fold, x, y).select(fold, "slope", "intercept")
    return df.join(F.broadcast(lines), fold).withColumn("prediction", F.col("slope") * F.col(x) + F.col("intercept")).drop("slope", "intercept")


def quota_sample(df: DataFrame, source: str, id_col: str, per_source: int, total: int) -> DataFrame:
    """Rows taken round-robin from the sources, at most ``per_source`` of each and ``total`` in all, with weights that sum to one per source."""
    placed = numbered(df.withColumn("__h", F.md5(F.col(id_col).cast("string"))), [F.col(source), F.col("__h")], "__g")
    first = placed.groupBy(F.col(source).alias("__s")).agg(F.min("__g").alias("__f"))
    placed = placed.join(F.broadcast(first), F.col(source) == F.col("__s")).withColumn("__p", F.col("__g") - F.col("__f") + 1).where(F.col("__p") <= per_source)
    chosen = numbered(placed, [F.col("__p"), F.col(source)], "__r").where(F.col("__r") <= total)
    counts = chosen.groupBy(F.col(source).alias("__t")).agg(F.count("*").alias("__n"))
    return chosen.join(F.broadcast(counts), F.col(source) == F.col("__t")).withColumn("weight", 1 / F.col("__n")).select(*df.columns, "weight")


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups to ``n`` rows in each task before they meet."""
    from pyspark.sql import Window as W

    return df.withColumn("__p", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__p") <= n).drop("__p")


def digest(df: DataFrame, columns: Sequence[str], limit: int = 20_000) -> DataFrame:
    """A digest of the first ``limit`` rows in sorted order, whatever their order in the table."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return df.select(row.alias("r")).orderBy("r").limit(limit).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), ""), 256).alias("digest"), F.count("*").alias("n"))


def latin_design(n: int, bounds: dict[str, tuple[float, float]], points: DataFrame, id_col: str) -> DataFrame:
    """A Latin hypercube over the bounds for the rows given: in every dimension each of ``n`` strata is used once."""
    out = points
    for name, (low, high) in bounds.items():
        mixed = numbered(points.select(F.col(id_col).alias("__i"), F.md5(F.concat_ws(":", F.lit(name), F.col(id_col).cast("string"))).alias("__h")), ["__h"], "__s")
        out = out.join(mixed.select("__i", (F.lit(low) + (F.col("__s") - 0.5) / F.lit(n) * (high - low)).alias(name)), F.col(id_col) == F.col("__i")).drop("__i")
    return out


def split_half(df: DataFrame, unit: str, label: str, feature: str, value: str) -> DataFrame:
    """By label, the correlation of a profile's two halves of random units."""
    half = F.conv(F.substring(F.md5(F.col(unit).cast("string")), 1, 8), 16, 10).cast("long") % 2
    sums = df.withColumn("h", half).groupBy(label, feature).agg(F.sum(F.when(F.col("h") == 0, F.col(value)).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("h") == 1, F.col(value)).otherwise(0.0)).alias("b"))
    return sums.groupBy(label).agg(F.count("*").alias("n_features"), F.corr("a", "b").alias("reliability"))


def control_pairs(df: DataFrame, id_col: str, group: str, control: Column) -> DataFrame:
    """For every row that is no control one control of its group, dealt by hash order in turn."""
    from pyspark.sql import Window as W

    order = F.md5(F.col(id_col).cast("string"))
    pool = df.where(control).withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy(order)) - 1)
    size = pool.groupBy(group).agg(F.count("*").alias("__n"))
    rows = df.where(~control).join(size, group).withColumn("__k", (F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) % F.col("__n"))
    return rows.select(F.col(id_col), F.col(group), "__k").join(pool.select(F.col(group), "__k", F.col(id_col).alias("control_id")), [group, "__k"]).drop("__k")
