"""Summaries of tables: profiles, conditional counts, rates with totals, replication and comparison.

Each is one aggregation with map-side combination, or two where a total is
needed beside its parts; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators.cleaning import present


def variable_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, value)``, one row per cell."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), present(F.col(c).cast("double")).alias("value")) for c in columns])).alias("cell")).select("cell.*")


def variable_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, mean, sample deviation, least and greatest by variable."""
    v = F.col("value")
    return variable_rows(df, columns).groupBy("variable").agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def summary_map(summary: DataFrame) -> DataFrame:
    """The rows of :func:`variable_summary` as one map from variable to its statistics."""
    fields = F.struct(*[c for c in summary.columns if c != "variable"])
    return summary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", fields.alias("stats"))))).alias("summary"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 50, most_levels: int = 50) -> DataFrame:
    """By column: rows, nulls, distinct values, whether they read as numbers, its kind, and the ``top`` values.

    All columns are counted in one pass over (column, value); the top values of
    a column come from those counts.
    """
    columns = list(columns or df.columns)
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("cell")).select("cell.*")
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    numeric = F.col("value").try_cast("double").isNotNull()
    shape = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_unique"),
        F.coalesce(F.bool_and(F.when(known, numeric)), F.lit(False)).alias("numeric"), F.min(F.when(known, F.col("n"))).alias("rarest"),
        F.max_by("value", F.struct(F.when(known, F.col("n")), F.col("value"))).alias("most_common"),
    )
    filled = F.col("n_rows") - F.col("n_null")
    kind = F.when(filled == 0, "empty").when(F.col("n_unique") == 1, "constant").when(F.col("n_unique") == 2, "binary").when(F.col("numeric"), "numeric")
    kind = kind.when(F.col("n_unique") <= most_levels, "category").when(F.col("n_unique") == filled, "identifier").otherwise("text")
    return shape.withColumn("null_share", F.col("n_null") / F.col("n_rows")).withColumn("kind", kind)


def value_counts(df: DataFrame, column: str, top: int = 50) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def rates(df: DataFrame, flags: Mapping[str, Column], by: Sequence[str] = (), means: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows, and of each flag how many meet it and their share of all; ``means`` are averaged beside."""
    told = [F.count("*").alias("n")]
    for name, flag in flags.items():
        told += [F.count_if(flag).alias(f"n_{name}"), (F.count_if(flag) / F.count("*")).alias(f"{name}_rate")]
    return df.groupBy(*by).agg(*told, *[F.avg(c).alias(f"mean_{n}") for n, c in (means or {}).items()])


def rates_with_total(df: DataFrame, by: str, flag: Column, total: str = "all") -> DataFrame:
    """Share of rows that meet ``flag`` by kind, and for all kinds together."""
    out = df.where(F.col(by).isNotNull()).rollup(by).agg(F.count("*").alias("n"), F.count_if(flag).alias("hits"))
    return out.select(F.coalesce(F.col(by).cast("string"), F.lit(total)).alias(by), "n", "hits", (F.col("hits") / F.col("n")).alias("rate"))


def sums_with_total(df: DataFrame, by: str, sums: Sequence[str], total: str = "all") -> DataFrame:
    out = df.where(F.col(by).isNotNull()).rollup(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return out.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit(total)))


def change_summary(df: DataFrame, by: Sequence[str], change: str, p: str, least: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """By group: size, mean change, how many rise, fall or are significant, and the common direction."""
    c = F.col(change)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(c).alias("mean_change"), F.count_if(c > 0).alias("n_up"), F.count_if(c < 0).alias("n_down"), F.count_if(F.col(p) < alpha).alias("n_significant"))
    return out.withColumn("direction", F.when(F.col("mean_change") > least, "up").when(F.col("mean_change") < -least, "down").otherwise("unchanged"))


def across_groups(groups: DataFrame, value: str, universal: float = 0.2) -> DataFrame:
    """Mean and population deviation of a per-group value; little spread makes it universal."""
    out = groups.agg(F.count(value).alias("n_groups"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean"))).withColumn("universal", F.coalesce(F.col("cv") < universal, F.lit(False)))


def replication(df: DataFrame, cluster: str, run: str, effect: str, p: str, score: str, text: str, n_runs: int, alpha: float = 0.05) -> DataFrame:
    """By cluster of findings: share of runs, spread of effects, majorities, and the text of the best score."""
    e = F.col(effect)
    out = df.groupBy(cluster).agg(
        F.count("*").alias("n"), (F.count_distinct(run) / F.lit(n_runs)).alias("replication_rate"), F.avg(e).alias("effect_mean"), F.stddev_pop(e).alias("effect_std"),
        (F.avg((F.col(p) < alpha).cast("int")) > 0.5).alias("mostly_significant"), (F.greatest(F.count_if(e > 0), F.count_if(e < 0)) / F.count(e)).alias("direction_agreement"),
        F.max_by(text, F.struct(F.col(score), F.col(text))).alias("summary"),
    )
    return out.withColumn("effect_cv", F.when(F.col("effect_mean") != 0, F.col("effect_std") / F.abs("effect_mean"))).withColumn("strength", strength(F.col("replication_rate")))


def strength(rate: Column) -> Column:
    """Label of a replication rate."""
    return F.when(rate >= 0.8, "strong").when(rate >= 0.6, "moderate").when(rate >= 0.4, "weak").otherwise("none")


def replication_counts(clusters: DataFrame, runs: str = "n_runs") -> DataFrame:
    """Clusters met in one run, in two or three, and in more."""
    n = F.col(runs)
    return clusters.agg(F.count("*").alias("n_clusters"), F.count_if(n == 1).alias("once"), F.count_if(n.between(2, 3)).alias("few"), F.count_if(n >= 4).alias("many"), F.avg(F.when(n > 1, n)).alias("mean_runs_repeated"))


def conditional_rollup(df: DataFrame, by: Sequence[str], p: str, totals: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Number of rows, least p, how many are significant, and sums."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(p).alias("min_p"), F.count_if(F.col(p) < alpha).alias("n_significant"), *[F.sum(c).alias(f"total_{c}") for c in totals])


def complement_sums(df: DataFrame, group: str, amount: str, enough: float) -> DataFrame:
    """Each group's sum beside that of all others, their ratio, and whether the others suffice."""
    own = df.groupBy(group).agg(F.sum(amount).alias("own"))
    out = own.crossJoin(F.broadcast(own.agg(F.sum("own").alias("all"))))
    return out.select(group, "own", (F.col("all") - F.col("own")).alias("others"), F.try_divide(F.col("all") - F.col("own"), F.col("own")).alias("ratio"), (F.col("all") - F.col("own") >= enough).alias("enough"))


def collapse(df: DataFrame, by: Sequence[str], mergeable: Column, member: str) -> DataFrame:
    """Rows that may be merged become one per group with their members listed; the others stay as they are."""
    merged = df.where(mergeable).groupBy(*by).agg(F.array_sort(F.collect_list(F.col(member))).alias("members"))
    return merged.unionByName(df.where(~F.coalesce(mergeable, F.lit(False))).select(*by, F.array(member).alias("members")))


def matrix_guard(df: DataFrame, columns: Sequence[str], most: float = 1e6) -> DataFrame:
    """By column: entries that are no finite numbers, the greatest magnitude, and whether it is all zero or too large."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    out = rows.groupBy("column").agg(F.count_if(~F.coalesce(finite, F.lit(False))).alias("n_bad"), F.max(F.when(finite, F.abs(v))).alias("max_abs"))
    return out.withColumn("all_zero", F.col("max_abs") == 0).withColumn("overflow", F.col("max_abs") > most)


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of several columns, in one row."""
    return df.agg(F.count("*").alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def recall_comparison(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """Recall by class of two predictions and the gain, rarest class first."""
    hit = lambda g: F.avg((F.col(truth) == F.col(g)).cast("double"))
    out = df.groupBy(F.col(truth).alias("class")).agg(F.count("*").alias("support"), hit(first).alias("baseline"), hit(second).alias("augmented"))
    return out.withColumn("gain", F.col("augmented") - F.col("baseline")).orderBy("support", "class")


def compare_results(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys of either result, whether both have them and their values agree within the tolerance."""
    both = left.select(F.col(key), F.col(value).alias("first"), F.lit(True).alias("in_first")).join(right.select(F.col(key), F.col(value).alias("second"), F.lit(True).alias("in_second")), key, "full_outer")
    status = F.when(F.col("in_second").isNull(), "missing").when(F.col("in_first").isNull(), "added").when(F.col("first").eqNullSafe(F.col("second")) | (F.abs(F.col("first") - F.col("second")) <= tolerance), "same").otherwise("differs")
    return both.select(key, "first", "second", status.alias("status"))


def anomaly_flags(df: DataFrame, p: str, effect: str, cv: str, tiny: float = 0.1, large: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Reasons to look twice at a result."""
    p_, e = F.col(p), F.abs(F.col(effect))
    reasons = F.array_compact(F.array(
        F.when((p_ < alpha) & (e < tiny), F.lit("significant but tiny")),
        F.when((p_ >= alpha) & (e > large), F.lit("large but not significant")),
        F.when((p_ == 0) | (p_ == 1), F.lit("degenerate p")),
        F.when(F.col(cv) > 1, F.lit("high variation")),
    ))
    return df.withColumn("flags", reasons)


def cross_row_patterns(df: DataFrame, series: str, order: str, effect: str, p: str) -> DataFrame:
    """By series of results: one sign throughout (3 or more), a monotone trend (4 or more), p-values at both ends (5 or more)."""
    w = W.partitionBy(series).orderBy(order)
    step = df.withColumn("step", F.col(effect) - F.lag(effect).over(w))
    out = step.groupBy(series).agg(
        F.count("*").alias("n"), ((F.count("*") >= 3) & (F.bool_and(F.col(effect) > 0) | F.bool_and(F.col(effect) < 0))).alias("one_sign"),
        ((F.count("*") >= 4) & (F.bool_and(F.col("step") > 0) | F.bool_and(F.col("step") < 0))).alias("monotone"),
        ((F.count("*") >= 5) & (F.count_if(F.col(p) < 0.05) > 0) & (F.count_if(F.col(p) > 0.5) > 0) & (F.count_if(F.col(p).between(0.05, 0.5)) == 0)).alias("bimodal_p"),
    )
    return out


def coalesce_duplicates(df: DataFrame, key: str, order: str, first: Sequence[str], greatest: Sequence[str] = (), union: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first non-empty text of each field in order, greatest numbers, united arrays."""
    filled = lambda c: F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, F.col(c))
    return df.groupBy(key).agg(*[F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col(order))).alias(c) for c in first], *[F.max(c).alias(c) for c in greatest], *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in union])


def set_call(df: DataFrame, cell: str, label: str, amount: str, none: str = "none", several: str = "multiple") -> DataFrame:
    """By cell its one label, or that it has none or several, with the sum of amounts."""
    out = df.groupBy(cell).agg(F.array_sort(F.collect_set(F.when(F.col(amount) > 0, F.col(label)))).alias("labels"), F.sum(amount).alias("total"))
    return out.select(cell, F.when(F.size("labels") == 0, none).when(F.size("labels") == 1, F.col("labels")[0].cast("string")).otherwise(several).alias("call"), "total")


def inverted_sets(df: DataFrame, key: str, listed: str, separator: str = r",\s*") -> DataFrame:
    """From keys with lists of items, each item with its sorted keys joined by semicolons."""
    each = df.select(F.col(key).cast("string").alias("key"), F.explode(F.split(listed, separator)).alias("item")).where("trim(item) <> ''")
    return each.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("key")), ";").alias("keys"))


def sums_top(df: DataFrame, name: str, amount: str, top: int) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"), F.sum(amount).alias("total")).orderBy(F.desc("total"), name).limit(top)


def coverage(df: DataFrame, column: str, known: DataFrame, key: str, ignored: Sequence[str] = ()) -> DataFrame:
    """Distinct values named, and the share that is among the known ones."""
    named = df.select(F.col(column).alias("k")).where(F.col("k").isNotNull() & ~F.col("k").cast("string").isin(*ignored)).distinct()
    met = named.join(known.select(F.col(key).alias("k"), F.lit(1).alias("hit")).distinct(), "k", "left")
    return met.agg(F.count("*").alias("named"), F.count("hit").alias("known")).withColumn("coverage", F.try_divide("known", "named"))


def screen_summary(labels: DataFrame, cell: str, condition: str, control: str, separator: str = r"\+") -> DataFrame:
    """Cells, controls, single and combined conditions, and least cells per condition."""
    by = labels.groupBy(condition).agg(F.count_distinct(cell).alias("n")).withColumn("parts", F.size(F.split(condition, separator))).withColumn("is_control", F.col(condition) == control)
    return by.agg(F.sum("n").alias("n_cells"), F.coalesce(F.sum(F.when(F.col("is_control"), F.col("n"))), F.lit(0)).alias("n_controls"), F.count_if(~F.col("is_control") & (F.col("parts") == 1)).alias("n_single"), F.count_if(F.col("parts") > 1).alias("n_combined"), F.min(F.when(~F.col("is_control"), F.col("n"))).alias("least_cells"))


def change_totals(df: DataFrame, change: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Tested, significant, up, down and the percentage that is significant."""
    sig = F.col(p) < alpha
    out = df.agg(F.count(p).alias("tested"), F.count_if(sig).alias("significant"), F.count_if(sig & (F.col(change) > 0)).alias("up"), F.count_if(sig & (F.col(change) < 0)).alias("down"))
    return out.withColumn("percent", F.try_divide(F.lit(100.0) * F.col("significant"), F.col("tested")))


def unit_cost(df: DataFrame, done: Column, good: Column, cost: str) -> DataFrame:
    """Shares done and good, and cost per good row (NULL if there is none)."""
    out = df.agg(F.count("*").alias("n"), F.avg(done.cast("double")).alias("saturation"), F.avg(good.cast("double")).alias("discovery_rate"), F.sum(cost).alias("cost"), F.count_if(good).alias("good"))
    return out.withColumn("cost_per_good", F.try_divide("cost", "good"))


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
