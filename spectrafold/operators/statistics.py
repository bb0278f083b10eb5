"""Descriptive statistics, tests of hypotheses and corrections for many tests.

Everything is one aggregation with map-side combination, by group where groups
are given.  Probabilities come from :mod:`spectrafold.functions.distributions`
applied to the few result rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.functions.distributions import chi2_upper, f_upper, normal_two_sided, t_two_sided
from spectrafold.operators.cleaning import present
from spectrafold.session import cut_lineage


def running_counts(df: DataFrame, value: Column) -> DataFrame:
    """``(v, n, upto)``: distinct values, how often each occurs, and how many rows lie at or below it.

    Values are counted first and the running count is taken per range of values,
    so that no single task sorts all rows: a prefix sum over the ranges, and one
    within each.  The ranges are written, so that every reader sees the same.
    """
    counted = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    counted = cut_lineage(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = counted.groupBy("part").agg(F.sum("n").alias("size"))
    before = parts.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))
    inner = F.sum("n").over(W.partitionBy("part").orderBy("v"))
    return counted.withColumn("inner", inner).join(F.broadcast(before), "part").select("v", "n", (F.col("before") + F.col("inner")).alias("upto"))


def quantiles(df: DataFrame, value: str | Column, probabilities: Sequence[float]) -> DataFrame:
    """One row with the exact interpolated quantiles ``q0``, ``q1``, ..., from running counts."""
    counts = running_counts(df, present(value).cast("double"))
    wide = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    told = []
    for i, p in enumerate(probabilities):
        at = F.lit(p) * (F.col("total") - 1)
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            told.append(F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("v"))).alias(f"{side}{i}"))
    row = wide.agg(F.max("total").alias("total"), *told)
    share = lambda p: F.lit(p) * (F.col("total") - 1) - F.floor(F.lit(p) * (F.col("total") - 1))
    return row.select(*[(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * share(p)).alias(f"q{i}") for i, p in enumerate(probabilities)])


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: str | Column, probabilities: Sequence[float]) -> DataFrame:
    """``g`` (a struct of the group's columns) with the exact interpolated quantiles ``q0``, ``q1``, ... of each group.

    Values are counted by group and dealt by ranges of (group, value); what lies
    before a range in its group comes from one row a range and group.  No buffer
    holds a group's values.
    """
    v = present(value).cast("double")
    counted = df.where(v.isNotNull()).groupBy(F.struct(F.lit(0).alias("__none"), *by).alias("g"), v.alias("v")).agg(F.count("*").alias("n"))
    ranged = cut_lineage(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("g", "part").agg(F.sum("n").alias("size"))
    before = parts.select("g", "part", (F.sum("size").over(W.partitionBy("g").orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(W.partitionBy("g")).alias("total"))
    rows = ranged.withColumn("inner", F.sum("n").over(W.partitionBy("g", "part").orderBy("v"))).join(before, ["g", "part"]).select("g", "v", "n", "total", (F.col("inner") + F.col("before")).alias("upto"))
    told = []
    for i, p in enumerate(probabilities):
        at = F.lit(p) * (F.col("total") - 1)
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            told.append(F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("v"))).alias(f"{side}{i}"))
    out = rows.groupBy("g").agg(F.max("total").alias("total"), *told)
    share = lambda p: F.lit(p) * (F.col("total") - 1) - F.floor(F.lit(p) * (F.col("total") - 1))
    return out.select("g", *[(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * share(p)).alias(f"q{i}") for i, p in enumerate(probabilities)])


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, moments and exact interpolated quantiles of a column; skewness and kurtosis are those of the population."""
    v = present(column).cast("double")
    out = df.groupBy(F.struct(F.lit(0).alias("__none"), *by).alias("g")).agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("variance"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
    )
    names = ("p5", "p10", "q1", "median", "q3", "p90", "p95")
    q = grouped_quantiles(df, by, column, (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
    out = out.join(q.withColumnsRenamed({f"q{i}": n for i, n in enumerate(names)} | {"g": "__g"}), F.col("g") == F.col("__g"), "left").drop("__g")
    out = out.select("g.*", *[c for c in out.columns if c != "g"]).drop("__none")
    return out.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1"), "cv": F.when(F.col("mean") != 0, F.col("std") / F.abs("mean"))})


def t_test(df: DataFrame, group: str, measure: str, first, second, log: bool = False) -> DataFrame:
    """Student's pooled two-sample t of ``first`` against ``second``, with means, sizes and the effect size d."""
    v = present(measure).cast("double")
    v = F.log2(v + 1) if log else v
    one, two = F.when(F.col(group) == first, v), F.when(F.col(group) == second, v)
    m = df.where(F.col(group).isin(first, second)).agg(
        F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("mean1"), F.avg(two).alias("mean2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2"),
    )
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2)
    gap = F.col("mean1") - F.col("mean2")
    return m.select(
        "n1", "n2", "mean1", "mean2", F.try_divide(gap, F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))).alias("t"), (F.col("n1") + F.col("n2") - 2).alias("df"),
        F.when(pooled > 0, gap / F.sqrt(pooled)).otherwise(0.0).alias("cohens_d"),
        F.when((F.col("mean1") > 0) & (F.col("mean2") > 0), F.log2(F.col("mean1") / F.col("mean2"))).alias("log2_fold_change"),
    )


def anova(df: DataFrame, group: str, measure: str) -> DataFrame:
    """One-way analysis of variance: F, degrees of freedom, eta squared."""
    v = present(measure).cast("double")
    g = df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("s2")).where("n > 0")
    t = g.agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum((F.col("n") - 1) * F.col("s2")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    t = t.withColumn("between", F.col("squares") - F.col("total") * F.col("grand") * F.col("grand"))
    f = F.try_divide(F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("total") - F.col("k")))
    return t.select("k", "total", f.alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("total") - F.col("k")).alias("df_within"), F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("eta_squared"))


def linear_fit(df: DataFrame, x: str | Column, y: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Pearson's r and the least-squares line of y on x, over rows that have both."""
    x, y = (present(c).cast("double") for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    m = df.groupBy(*by).agg(F.count(x).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.try_divide("c", "vx")
    m = m.withColumn("r", F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))))
    m = m.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    m = m.withColumn("r_squared", F.col("r") * F.col("r"))
    error = F.sqrt(F.try_divide(F.try_divide(F.col("vy") * (1 - F.col("r_squared")), F.col("vx")), F.col("n") - 2))
    return m.withColumn("std_err", error).where("n >= 3").drop("c", "vx", "vy", "mx", "my")


def power_law(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """y = a x^b over positive pairs, by a line in decimal logarithms."""
    good = df.where((present(x) > 0) & (present(y) > 0))
    fit = linear_fit(good.withColumns({"__x": F.log10(x), "__y": F.log10(y)}), "__x", "__y", by)
    return fit.withColumnRenamed("slope", "exponent").withColumn("factor", F.pow(F.lit(10.0), "intercept")).drop("intercept")


def mid_ranks(df: DataFrame, value: str, name: str = "mid_rank") -> DataFrame:
    """Ranks with ties averaged."""
    v = present(value).cast("double")
    ranked = running_counts(df, v).select(F.col("v").alias("__v"), (F.col("upto") - (F.col("n") - 1) / 2).alias(name), F.col("n").alias("ties"))
    return df.join(ranked, v == F.col("__v")).drop("__v")


def mann_whitney(df: DataFrame, group: str, measure: str, first, second) -> DataFrame:
    """U of the first group, with the tie-corrected normal score."""
    some = df.where(F.col(group).isin(first, second)).select(group, measure)
    ranked = mid_ranks(some, measure)
    one = F.col(group) == first
    m = ranked.agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n2"), F.sum(F.when(one, F.col("mid_rank"))).alias("r1"), F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("tied"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("tied") / (n * (n - 1))))
    return m.select("n1", "n2", u.alias("u"), ((u - F.col("n1") * F.col("n2") / 2) / spread).alias("z"))


def chi_square(df: DataFrame, row: str, column: str, yates: bool = True) -> DataFrame:
    """Chi-squared of independence with Cramér's V; a 2 x 2 table gets Yates's correction."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy("r").agg(F.sum("o").alias("nr")), cells.groupBy("c").agg(F.sum("o").alias("nc"))
    shape = rows.agg(F.count("*").alias("k"), F.sum("nr").alias("n")).crossJoin(columns.agg(F.count("*").alias("m")))
    grid = rows.crossJoin(columns).crossJoin(shape).join(cells, ["r", "c"], "left")
    expected, observed = F.col("nr") * F.col("nc") / F.col("n"), F.coalesce("o", F.lit(0))
    small = (F.col("k") == 2) & (F.col("m") == 2) & F.lit(yates)
    gap = F.abs(observed - expected)
    gap = F.when(small, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = grid.agg(F.sum(gap * gap / expected).alias("chi2"), F.max("k").alias("k"), F.max("m").alias("m"), F.max("n").alias("n"))
    return out.select("chi2", ((F.col("k") - 1) * (F.col("m") - 1)).alias("dof"), "n", F.sqrt(F.col("chi2") / (F.col("n") * (F.least("k", "m") - 1))).alias("cramers_v"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Numbers from 1 in an order, ranges of which are numbered apart: no task sorts all rows."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = parts.select("__part", (F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).alias("__before"))
    inner = ranged.withColumn("__inner", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    return inner.join(F.broadcast(before), "__part").withColumn(name, (F.col("__inner") + F.col("__before")).cast("int")).drop("__part", "__inner", "__before")


def running(df: DataFrame, order: str, value: str, name: str, largest: bool, backwards: bool = False) -> DataFrame:
    """The largest (or least) ``value`` among the rows up to each one in an order, or from each one on.

    As with :func:`numbered`, ranges of the order hold a running value each and
    take the value of the ranges passed before.
    """
    most, far = (F.max, F.greatest) if largest else (F.min, F.least)
    turn = F.desc if backwards else F.asc
    ranged = cut_lineage(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part").agg(most(value).alias("__own"))
    before = parts.select("__part", most("__own").over(W.orderBy(turn("__part")).rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    inner = most(value).over(W.partitionBy("__part").orderBy(turn(order)))
    return ranged.withColumn("__inner", inner).join(F.broadcast(before), "__part").withColumn(name, far("__inner", "__before")).drop("__part", "__inner", "__before")


def _beside(df: DataFrame, *totals: Column) -> DataFrame:
    """Every row with totals over all rows, as one broadcast row."""
    return df.crossJoin(F.broadcast(df.agg(*totals)))


def _ranked(df: DataFrame, p: str) -> DataFrame:
    """Tests in order of p with their rank and number."""
    known = df.where(F.col(p).isNotNull())
    return _beside(numbered(known, [p], "rank"), F.count("*").alias("m"))


def bonferroni(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    out = _beside(df, F.count(p).alias("m"))
    return out.withColumn("adjusted", F.least(F.col(p) * F.col("m"), F.lit(1.0))).withColumn("significant", F.col(p) < alpha / F.col("m"))


def benjamini_hochberg(df: DataFrame, p: str = "p", alpha: float = 0.05, monotone: bool = False) -> DataFrame:
    """Step-up decisions; adjusted values are p m / rank, made monotone only where asked for."""
    out = _ranked(df, p).withColumn("raw", F.least(F.col(p) * F.col("m") / F.col("rank"), F.lit(1.0)))
    out = _beside(out, F.max(F.when(F.col(p) <= alpha * F.col("rank") / F.col("m"), F.col("rank"))).alias("__last"))
    # Made monotone, each is the least from its rank on.
    out = running(out, "rank", "raw", "adjusted", largest=False, backwards=True) if monotone else out.withColumn("adjusted", F.col("raw"))
    return out.withColumn("significant", F.col("rank") <= F.coalesce("__last", F.lit(0))).drop("raw", "__last")


def holm(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down decisions that stop at the first failure."""
    out = _ranked(df, p)
    out = _beside(out, F.min(F.when(F.col(p) > alpha / (F.col("m") - F.col("rank") + 1), F.col("rank"))).alias("__fails"))
    out = out.withColumn("__step", F.least(F.col(p) * (F.col("m") - F.col("rank") + 1), F.lit(1.0)))
    out = running(out, "rank", "__step", "adjusted", largest=True)
    return out.withColumn("significant", F.col("rank") < F.coalesce("__fails", F.col("m") + 1)).drop("__fails", "__step")


def stars(p: Column) -> Column:
    """Label of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def with_p(result: DataFrame, test: str) -> DataFrame:
    """The p-value beside the statistic of a result of this module: ``t``, ``anova``, ``chi2``, ``u`` or ``r``."""
    if test == "t":
        p = t_two_sided(F.col("t"), F.col("df").cast("double"))
    elif test == "anova":
        p = f_upper(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    elif test == "chi2":
        p = chi2_upper(F.col("chi2"), F.col("dof").cast("double"))
    elif test == "u":
        p = normal_two_sided(F.col("z"))
    elif test == "r":
        df = (F.col("n") - 2).cast("double")
        p = t_two_sided(F.col("r") * F.sqrt(df / (1 - F.col("r") * F.col("r"))), df)
    else:
        raise ValueError(f"unknown test {test!r}")
    return result.withColumn("p", p)
