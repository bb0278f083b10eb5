"""Betweenness of nodes by counting shortest paths forward and adding up dependencies backward.

For each root the nodes are reached ring by ring with the number of shortest
paths to them; then, from the last ring back, each node takes from every node
that it leads to its share of the paths through that node.  A ring is written
once, in either direction, and only the newest ring is expanded.  The work is the
number of roots times the number of edges: all nodes as roots give the exact
values, a table of some roots their part of the sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.session import cut_lineage


def path_rings(edges: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """``(root, node, paths)`` of each distance from 0 on: nodes first reached there and how many shortest paths lead to them."""
    start = roots.select(F.col("node").alias("root"), "node").where("node IS NOT NULL").distinct().withColumn("paths", F.lit(1.0))
    rings = [cut_lineage(start)]
    reached = rings[0].select("root", "node")
    while True:
        ring = rings[-1]
        step = ring.join(edges, ring.node == edges.src).groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        step = cut_lineage(step.join(reached, ["root", "node"], "left_anti"))
        if step.isEmpty():
            return rings
        rings.append(step)
        reached = reached.union(step.select("root", "node"))


def betweenness(edges: DataFrame, roots: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """``(node, betweenness)`` for every node of ``edges(src, dst)``, read as directed.

    Normalised, the sum is divided by (n - 1)(n - 2), the pairs of other nodes;
    with two nodes or fewer it is 0.  Repeated edges count once; edges from a node
    to itself and those with a null end are ignored.  With ``roots(node)`` only
    paths that begin there count.
    """
    clean = cut_lineage(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    nodes = cut_lineage(clean.select(F.col("src").alias("node")).union(clean.select("dst")).distinct())
    rings = path_rings(clean, nodes if roots is None else roots.select("node").join(nodes, "node", "left_semi"))
    own = None
    total = []
    for k in range(len(rings) - 1, 0, -1):
        ring = rings[k].withColumn("gain", F.lit(0.0)) if own is None else own
        total.append(ring.select("node", "gain"))
        # Of what the node further out gains and itself counts for, each predecessor takes its share of the paths.
        further = ring.select("root", F.col("node").alias("dst"), ((1 + F.col("gain")) / F.col("paths")).alias("each"))
        shares = further.join(clean, "dst").select("root", F.col("src").alias("node"), "each").groupBy("root", "node").agg(F.sum("each").alias("each"))
        before = rings[k - 1].join(shares, ["root", "node"], "left")
        own = cut_lineage(before.select("root", "node", "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("gain")))
    sums = nodes.withColumn("gain", F.lit(0.0))
    for part in total:
        sums = sums.unionByName(part)
    sums = sums.groupBy("node").agg(F.sum("gain").alias("gain"))
    if not normalized:
        return sums.withColumnRenamed("gain", "betweenness")
    n = nodes.agg(F.count("*").alias("n"))
    return sums.crossJoin(F.broadcast(n)).select("node", F.when(F.col("n") > 2, F.col("gain") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("betweenness"))
