"""Sparse expression matrices as ``(cell, gene, value)`` rows; entries that are absent are zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def library_normalize(coo: DataFrame, target: float = 1e4) -> DataFrame:
    """``log1p(value / cell total * target)``; missing and negative values count as zero, empty cells divide by one."""
    value = F.greatest(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    clean = coo.withColumn("value", value)
    total = clean.groupBy("cell").agg(F.sum("value").alias("total"))
    scale = F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    return clean.join(total, "cell").select("cell", "gene", F.log1p(F.col("value") / scale * target).alias("value"))


def gene_moments(coo: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Mean and population variance per gene over all cells, zeros included; ``n_cells(n)`` is one row."""
    sums = coo.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count_if(F.col("value") > 0).alias("detected"))
    wide = sums.crossJoin(F.broadcast(n_cells))
    mean = F.col("s") / F.col("n")
    return wide.select("gene", "detected", mean.alias("mean"), F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))


def variable_genes(coo: DataFrame, n_cells: DataFrame, top: int, least_cells: int = 3) -> DataFrame:
    """Genes with the largest variance over mean among those seen in enough cells."""
    m = gene_moments(coo, n_cells).where((F.col("detected") >= least_cells) & (F.col("mean") > 0))
    return m.withColumn("dispersion", F.col("variance") / F.col("mean")).orderBy(F.desc("dispersion"), "gene").limit(top)


def clipped_scores(coo: DataFrame, n_cells: DataFrame) -> DataFrame:
    """z-scores per gene of the stored entries, negative ones as zero; a constant gene divides by one.

    Absent entries lie at or below the mean, so their score is zero as well and
    the matrix stays sparse.
    """
    m = gene_moments(coo, n_cells).withColumn("sd", F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0))
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    return coo.join(m, "gene").select("cell", "gene", F.greatest(z, F.lit(0.0)).alias("value"))


def pseudobulk(coo: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean value per label and gene over all of the label's cells, zeros included."""
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    sums = coo.join(labels, "cell").groupBy("label", "gene").agg(F.sum("value").alias("s"))
    return sums.join(F.broadcast(size), "label").select("label", "gene", (F.col("s") / F.col("n")).alias("mean"))


def delta(means: DataFrame, control: str) -> DataFrame:
    """Each label's mean less the control's, a gene absent on one side counting as zero."""
    base = means.where(F.col("label") == control).select("gene", F.col("mean").alias("base"))
    labels = means.where(F.col("label") != control).select("label").distinct()
    grid = means.select("gene").distinct().crossJoin(F.broadcast(labels))
    return grid.join(means, ["label", "gene"], "left").join(base, "gene", "left").select("label", "gene", (F.coalesce("mean", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))).alias("delta"))
