"""Graphs of genes that vary together, with the design of the experiment regressed out.

Values are kept as ``(sample, gene, value)`` rows whose missing cells are zero.
What is left of two genes after a regression on the design has the covariance
Y'Y - Y'X (X'X)^-1 X'Y, so no residuals are made: X'X and X'Y are sums, and Y'Y
is added up from blocks of samples, each task holding one block as a matrix
and one sum of products of the panel.  Pairs never become rows: products travel as one array a
gene, and a gene's array is cut to its strongest partners where it is summed.

The panel is bounded (``MOST_GENES``), as is the number of design columns; both
are checked, as p genes take p² numbers in a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.cleaning import present
from spectrafold.session import cut_lineage

MOST_GENES, MOST_COLUMNS, BLOCK = 4096, 256, 512


def one_hot_design(samples: DataFrame, sample: str, columns: Sequence[str]) -> DataFrame:
    """``(sample, design)``: a 0/1 array of all levels of the columns but the first of each; a null is a level of its own."""
    levels = {}
    for c in columns:
        found = samples.select(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")).distinct().orderBy("v").limit(MOST_COLUMNS + 2).collect()
        levels[c] = [r.v for r in found][1:]
    if sum(map(len, levels.values())) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} design columns")
    told = [(F.coalesce(F.col(c).cast("string"), F.lit("")) == v).cast("double") for c in columns for v in levels[c]]
    return samples.select(F.col(sample).alias("sample"), F.array(*told).cast("array<double>").alias("design"))


def _products(p: int):
    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((p, p))
        for part in parts:
            genes, values = part["genes"].to_numpy(), part["values"].to_numpy()
            for a in range(0, len(part), BLOCK):
                block = np.zeros((min(BLOCK, len(part) - a), p))
                for row in range(len(block)):
                    block[row, genes[a + row]] = values[a + row]
                gram += block.T @ block
        for g in np.flatnonzero(gram.any(axis=1)):
            yield pd.DataFrame({"gene": [int(g)], "products": [gram[g]]})

    return multiply


def residual_graph(values: DataFrame, design: DataFrame, k: int = 20, threshold: float = 0.4) -> DataFrame:
    """Edges ``(src, dst, weight)``: for each gene (dst) its ``k`` strongest others by |r| above the threshold, and itself with weight 1.

    ``values(sample, gene, value)`` of the samples in ``design(sample, design)``
    count, repeated cells summed; an intercept is always part of the design. A
    gene that the design explains fully has no partners. Ties go to the lesser gene.
    """
    design = cut_lineage(design.where("sample IS NOT NULL").dropDuplicates(["sample"]))
    cells = values.join(design.select("sample"), "sample", "left_semi").where("gene IS NOT NULL")
    cells = cut_lineage(cells.groupBy("sample", "gene").agg(F.sum(present("value").cast("double")).alias("value")).where("value <> 0"))
    names = [r.gene for r in cells.select("gene").distinct().orderBy("gene").limit(MOST_GENES + 1).collect()]
    if len(names) > MOST_GENES:
        raise ValueError(f"a panel of more than {MOST_GENES} genes; choose one first")
    if not names:
        return cells.select(F.col("gene").alias("src"), F.col("gene").alias("dst"), F.lit(0.0).alias("weight")).limit(0)
    spark, kind = values.sparkSession, cells.schema["gene"].dataType.simpleString()
    index = spark.createDataFrame(list(enumerate(names)), f"g int, gene {kind}")
    cells = cells.join(F.broadcast(index), "gene").select("sample", "g", "value")
    width = design.select(F.max(F.size("design")).alias("q")).first().q or 0
    if width > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} design columns")
    x = lambda i: F.lit(1.0) if i == 0 else F.get("design", F.lit(i - 1))
    q, p = width + 1, len(names)
    xx = design.agg(*[F.coalesce(F.sum(x(i) * x(j)), F.lit(0.0)).alias(f"x{i}_{j}") for i in range(q) for j in range(i, q)]).first()
    gram = np.zeros((q, q))
    at = iter(xx)
    for i in range(q):
        for j in range(i, q):
            gram[i, j] = gram[j, i] = next(at)
    sums = cells.join(design, "sample").groupBy("g").agg(*[F.sum(x(i) * F.col("value")).alias(f"z{i}") for i in range(q)], F.sum(F.col("value") * F.col("value")).alias("yy")).collect()
    z, yy = np.zeros((q, p)), np.zeros(p)
    for r in sums:
        z[:, r.g], yy[r.g] = r[1 : q + 1], r.yy
    beta = np.linalg.pinv(gram) @ z
    left = yy - (z * beta).sum(axis=0)
    left[left <= 1e-10 * np.maximum(yy, 1e-300)] = 0.0
    rows = cells.groupBy("sample").agg(F.collect_list(F.struct("g", "value")).alias("c")).select(F.transform("c", lambda c: c["g"]).alias("genes"), F.transform("c", lambda c: c["value"]).alias("values"))
    partial = rows.mapInPandas(_products(p), "gene int, products array<double>")

    def strongest(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        rest = np.sum(np.stack(part["products"].to_numpy()), axis=0) - z[:, g] @ beta
        scale = np.sqrt(left[g] * left)
        r = np.abs(np.divide(rest, scale, out=np.zeros(p), where=scale > 0))
        r[g] = 0.0
        best = np.lexsort((np.arange(p), -r))[:k]
        best = best[r[best] > threshold]
        return pd.DataFrame({"s": [g, *best.tolist()], "d": [g] * (len(best) + 1), "weight": [1.0, *r[best].tolist()]})

    edges = partial.groupBy("gene").applyInPandas(strongest, "s int, d int, weight double")
    named = lambda c, to: F.broadcast(index.select(F.col("g").alias(c), F.col("gene").alias(to)))
    return edges.join(named("s", "src"), "s").join(named("d", "dst"), "d").select("src", "dst", "weight")


def edge_overlap(first: DataFrame, second: DataFrame, no_edges: float = 0.0) -> DataFrame:
    """Undirected edges without loops of each graph, those of both, and their share of all; a share of no edges at all is ``no_edges``."""
    sides = [g.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn(n, F.lit(1)) for g, n in ((first, "l"), (second, "r"))]
    both = sides[0].join(sides[1], ["a", "b"], "full_outer").agg(F.count("l").alias("edges_first"), F.count("r").alias("edges_second"), F.count(F.col("l") + F.col("r")).alias("shared"))
    share = lambda of: F.coalesce(F.try_divide("shared", of), F.lit(no_edges))
    return both.withColumns({"jaccard": share(F.col("edges_first") + F.col("edges_second") - F.col("shared")), "of_first": share(F.col("edges_first")), "of_second": share(F.col("edges_second"))})
