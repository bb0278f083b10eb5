"""Tests and checks of count matrices kept as ``(sample, gene, value)`` rows.

Cells that are not stored are zero.  A gene's moments over a condition follow
from its stored cells and the number of samples, so zeros are never made:
with m stored values of mean a and summed squared deviation s, n values have the
mean a m / n and the deviation s + a² m (n - m) / n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.functions.distributions import t_two_sided
from spectrafold.operators.cleaning import present
from spectrafold.operators.statistics import benjamini_hochberg


def _side(side: int, n: Column) -> tuple[Column, Column]:
    """Mean and summed squared deviation of the log values of one side, zeros included."""
    m, a = F.coalesce(f"m{side}", F.lit(0)), F.coalesce(f"a{side}", F.lit(0.0))
    s = F.coalesce(F.col(f"v{side}"), F.lit(0.0)) * m
    return a * m / n, s + a * a * m * (n - m) / n


def differential_expression(counts: DataFrame, samples: DataFrame, sample: str, gene: str, value: str, condition: str, case, control, least: float = 10, alpha: float = 0.05) -> DataFrame:
    """Per gene of a total of at least ``least``: fold change, t, p and adjusted p of case against control.

    Counts of a gene in a sample are summed first and the total covers all
    samples, also those of other conditions or without one.  The test is
    Student's pooled t on log2(x + 1), adjusted by Benjamini and Hochberg.  A gene that is constant
    within both conditions has p 0 if they differ and none if they don't, and then
    takes no part in the adjustment.  ``samples`` names each sample once; without
    samples of either condition there are no rows.
    """
    cells = counts.where(F.col(gene).isNotNull()).groupBy(F.col(gene).alias("gene"), F.col(sample).alias("sample")).agg(F.sum(present(value).cast("double")).alias("x")).where("x <> 0")
    sided = samples.where(F.col(sample).isNotNull()).select(F.col(sample).alias("sample"), F.when(F.col(condition) == case, 1).when(F.col(condition) == control, 2).alias("side")).where("side IS NOT NULL").distinct()
    sizes = sided.agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2")).where("n1 > 0 AND n2 > 0")
    met, log = cells.join(sided, "sample", "left"), F.log2(F.col("x") + 1)
    told = [F.sum("x").alias("total"), F.coalesce(F.sum(F.when(F.col("side").isNotNull(), F.col("x"))), F.lit(0.0)).alias("both")]
    for side in (1, 2):
        v = F.when(F.col("side") == side, log)
        told += [F.count(v).alias(f"m{side}"), F.avg(v).alias(f"a{side}"), F.var_pop(v).alias(f"v{side}")]
    genes = met.groupBy("gene").agg(*told).where(F.col("total") >= least).crossJoin(F.broadcast(sizes))
    (mean1, dev1), (mean2, dev2) = _side(1, F.col("n1")), _side(2, F.col("n2"))
    df = (F.col("n1") + F.col("n2") - 2).cast("double")
    genes = genes.select("gene", (mean1 - mean2).alias("log2_fold_change"), F.try_divide(dev1 + dev2, df).alias("pooled"), df.alias("df"), (1 / F.col("n1") + 1 / F.col("n2")).alias("inverse"), (F.col("both") / (F.col("n1") + F.col("n2"))).alias("base_mean"))
    # Deviations of constant values are rounding errors of the sums.
    flat = F.col("pooled") <= 1e-20
    t = F.when(~flat, F.col("log2_fold_change") / F.sqrt(F.col("pooled") * F.col("inverse")))
    genes = genes.withColumn("t", t).withColumn("p", F.when(flat & (F.col("log2_fold_change") != 0), 0.0).when(~flat, t_two_sided(F.coalesce("t", F.lit(0.0)), F.col("df"))))
    adjusted = benjamini_hochberg(genes, "p", alpha, monotone=True).drop("m", "rank")
    out = adjusted.unionByName(genes.where("p IS NULL").withColumns({"adjusted": F.lit(None).cast("double"), "significant": F.lit(False)}))
    up = F.when(F.col("log2_fold_change") > 0, "up").when(F.col("log2_fold_change") < 0, "down").otherwise("unchanged")
    out = out.withColumn("significant", F.coalesce(F.col("adjusted") < alpha, F.lit(False)))
    return out.select("gene", "base_mean", "log2_fold_change", "t", "p", "adjusted", "significant", F.when(F.col("significant"), up).otherwise("unchanged").alias("direction"))


def expression_summary(result: DataFrame) -> DataFrame:
    """How many genes were tested, significant, up and down."""
    return result.agg(
        F.count("*").alias("n_tested"), F.count_if("significant").alias("n_significant"),
        F.count_if(F.col("direction") == "up").alias("n_up"), F.count_if(F.col("direction") == "down").alias("n_down"),
    )
