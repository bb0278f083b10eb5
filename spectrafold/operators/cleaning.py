"""Projection, filters and cleaning of tables.

NaN counts as missing everywhere, so operators see it as NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts that stand for a missing entry, after trimming and lower-casing.
MISSING_TEXTS = ("", "?", "na", "n/a", "nan", "none", "null")


def present(column: str | Column) -> Column:
    """The column with NaN as NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c.cast("double")), c)


def remove_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def filter_positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every column is above zero; a missing value is not."""
    for c in columns:
        df = df.where(present(c) > 0)
    return df


def remove_outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows within the IQR fences, or with an absolute population z-score under the threshold.

    The fences are one aggregated row joined back, so the data is not shuffled.
    """
    value = present(column)
    if method == "iqr":
        from spectrafold.operators.statistics import quantiles

        width = F.col("q1") - F.col("q0")
        fence = quantiles(df, column, (0.25, 0.75)).select((F.col("q0") - threshold * width).alias("low"), (F.col("q1") + threshold * width).alias("high"))
        kept = df.crossJoin(F.broadcast(fence)).where((value >= F.col("low")) & (value <= F.col("high")))
        return kept.drop("low", "high")
    if method == "zscore":
        m = df.agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"), F.count_if(value.isNull()).alias("gaps"))
        # A missing value leaves no z-score defined at all.
        kept = df.crossJoin(F.broadcast(m)).where((F.col("gaps") == 0) & (F.col("sd") > 0) & (F.abs((value - F.col("mu")) / F.col("sd")) < threshold))
        return kept.drop("mu", "sd", "gaps")
    raise ValueError(f"unknown method {method!r}")


def normalize(df: DataFrame, columns: Sequence[str], method: str = "zscore") -> DataFrame:
    """Sample z-scores or min-max scaling; constant columns stay as they are."""
    parts = []
    for i, c in enumerate(columns):
        v = present(c)
        parts += [F.avg(v).alias(f"__a{i}"), F.stddev_samp(v).alias(f"__s{i}")] if method == "zscore" else [F.min(v).alias(f"__a{i}"), (F.max(v) - F.min(v)).alias(f"__s{i}")]
    if method not in ("zscore", "minmax"):
        raise ValueError(f"unknown method {method!r}")
    wide = df.crossJoin(F.broadcast(df.agg(*parts)))
    scaled = {c: F.when(F.col(f"__s{i}") > 0, (F.col(c) - F.col(f"__a{i}")) / F.col(f"__s{i}")).otherwise(F.col(c).cast("double")) for i, c in enumerate(columns)}
    return wide.withColumns(scaled).select(*df.columns)


def tidy_name(name: Column) -> Column:
    """Lower case, everything but letters and digits to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_numeric_text(text: Column) -> Column:
    """Numbers from text, with the missing markers and unreadable entries as NULL."""
    trimmed = F.trim(text)
    return F.when(~F.lower(trimmed).isin(*MISSING_TEXTS), trimmed.try_cast("double"))


def latest(df: DataFrame, order: str, n: int, *conditions: Column) -> DataFrame:
    """Rows that meet all conditions, newest first, at most ``n``."""
    for c in conditions:
        df = df.where(c)
    return df.orderBy(F.desc(order)).limit(n)


def decayed_top(df: DataFrame, importance: str, at: str, now: Column, n: int) -> DataFrame:
    """Top rows by importance over age in days plus one."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.col(at))) / 86400.0
    return df.withColumn("rank_score", F.try_divide(F.col(importance), age + 1)).orderBy(F.desc("rank_score")).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark cuts each task's groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
