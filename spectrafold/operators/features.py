"""Encoding of columns and metrics of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.statistics import quantiles


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes of sorted levels from 0. Levels are few by contract and joined as a small table."""
    from pyspark.sql import Window as W

    levels = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, (F.row_number().over(W.orderBy(column)) - 1).cast("int"))
    return df.join(levels, column, "left")


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column per level and one for anything else."""
    known = {f"{column}={v}": (F.col(column).eqNullSafe(F.lit(v))).cast("int") for v in levels}
    return df.withColumns(known | {f"{column}=<unknown>": (~F.coalesce(F.col(column).isin(*levels), F.lit(False))).cast("int")})


def median_impute(df: DataFrame, column: str) -> DataFrame:
    """Missing entries replaced by the exact median, then z-scored with the population deviation after filling."""
    filled = df.crossJoin(F.broadcast(quantiles(df, column, (0.5,)).withColumnRenamed("q0", "__med"))).withColumn(column, F.coalesce(F.col(column).cast("double"), "__med")).drop("__med")
    m = filled.agg(F.avg(column).alias("__mu"), F.stddev_pop(column).alias("__sd"))
    return filled.crossJoin(F.broadcast(m)).withColumn(column, (F.col(column) - F.col("__mu")) / F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(1.0)).drop("__mu", "__sd")


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support by class, from one count of the confusion table."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0))
    by_truth = cells.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"), right.alias("hits"))
    by_guess = cells.groupBy(F.col("g").alias("class")).agg(F.sum("n").alias("guessed"))
    out = by_truth.join(by_guess, "class", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.col("guessed")).otherwise(0.0)
    recall = F.col("hits") / F.col("support")
    return out.select("class", "support", precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """mse, rmse, mae, r2 and the residuals' mean and population deviation; r2 is NULL without variance."""
    e = F.col(truth) - F.col(guess)
    m = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"), F.var_pop(truth).alias("v"))
    return m.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"), "residual_mean", "residual_std")
