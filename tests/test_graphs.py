"""Betweenness by counting paths, residual graphs by dense matrices."""

import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import coexpression as x
from spectrafold.operators import graphs as g


def counted_paths(edges, roots=None):
    nodes = sorted({n for e in edges for n in e})
    out = dict.fromkeys(nodes, 0.0)
    to = {n: {b for a, b in edges if a == n and b != n} for n in nodes}

    def search(s):
        dist, paths, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            v = queue.popleft()
            for w in to[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        return dist, paths

    found = {s: search(s) for s in nodes}
    for s in roots or nodes:
        for v in nodes:
            for t in nodes:
                if len({s, v, t}) == 3 and v in found[s][0] and t in found[v][0] and found[s][0].get(t) == found[s][0][v] + found[v][0][t]:
                    out[v] += found[s][1][v] * found[v][1][t] / found[s][1][t]
    return out


def test_betweenness(spark):
    draw = random.Random(1)
    edges = [(draw.randint(0, 24), draw.randint(0, 24)) for _ in range(60)]
    dirty = edges + edges[:9] + [(3, 3), (None, 4), (5, None)]
    df = spark.createDataFrame(dirty, "src long, dst long").withColumn("paths", F.lit("clash"))
    want = counted_paths([e for e in edges if e[0] != e[1]])
    n = len(want)
    got = {r.node: r.betweenness for r in g.betweenness(df).collect()}
    assert set(got) == set(want) and all(math.isclose(got[v], b / (n - 1) / (n - 2), abs_tol=1e-12) for v, b in want.items()) and max(got.values()) > 0
    roots = spark.createDataFrame([(1,), (2,), (99,)], "node long")
    some = {r.node: r.betweenness for r in g.betweenness(df, roots, normalized=False).collect()}
    part = counted_paths([e for e in edges if e[0] != e[1]], [v for v in (1, 2) if v in want])
    assert all(math.isclose(some[v], b, abs_tol=1e-12) for v, b in part.items())


def test_betweenness_of_small_graphs(spark):
    frame = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    assert g.betweenness(frame([])).count() == 0
    assert {r.betweenness for r in g.betweenness(frame([("a", "b")])).collect()} == {0.0}
    assert {r.node: r.betweenness for r in g.betweenness(frame([("a", "b"), ("b", "c")])).collect()} == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_residual_graph(spark):
    rng = np.random.default_rng(2)
    n, p = 90, 14
    batch, dose = rng.integers(0, 3, n), rng.normal(size=n)
    y = rng.normal(size=(n, p)) + batch[:, None] * rng.normal(size=p) * 4 + dose[:, None] * rng.normal(size=p)
    y[:, 1] = y[:, 0] + 0.3 * rng.normal(size=n)
    y[:, 2] = 3.0 * batch + 1.0
    y[rng.random((n, p)) < 0.3] = 0.0
    y[:, 2] = 3.0 * (batch == 1) + 1.0
    design = np.column_stack([np.ones(n), batch == 1, batch == 2, dose])
    rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    norm = np.sqrt((rest**2).sum(axis=0))
    r = np.abs(rest.T @ rest) / np.where(norm > 1e-8, np.outer(norm, norm), np.inf)
    np.fill_diagonal(r, 0.0)
    r[2] = r[:, 2] = 0.0
    want = {(f"g{j:02}", f"g{j:02}"): 1.0 for j in range(p)}
    for j in range(p):
        for i in np.lexsort((np.arange(p), -r[:, j]))[:4]:
            if r[i, j] > 0.1:
                want[f"g{i:02}", f"g{j:02}"] = r[i, j]
    cells = [(i, f"g{j:02}", float(y[i, j]) / 2) for i in range(n) for j in range(p) if y[i, j] for _ in range(2)] + [(n + 5, "g00", 9.0), (0, None, 1.0)]
    samples = spark.createDataFrame([(i, str(batch[i]), float(dose[i])) for i in range(n)], "cell long, batch string, dose double")
    told = x.one_hot_design(samples, "cell", ["batch"]).join(samples.select(F.col("cell").alias("sample"), "dose"), "sample")
    told = told.select("sample", F.concat("design", F.array("dose")).alias("design"))
    edges = x.residual_graph(spark.createDataFrame(cells, "sample long, gene string, value double").repartition(5), told, 4, 0.1)
    got = {(e.src, e.dst): e.weight for e in edges.collect()}
    assert set(got) == set(want) and all(math.isclose(got[e], w, rel_tol=1e-8) for e, w in want.items())
    overlap = x.edge_overlap(edges, edges.where("src < 'g05'")).first()
    assert overlap.of_second == 1.0 and 0 < overlap.jaccard <= 1


def test_residual_graph_edges(spark):
    values = spark.createDataFrame([], "sample long, gene string, value double")
    design = spark.createDataFrame([(1, [0.5])], "sample long, design array<double>")
    assert x.residual_graph(values, design).count() == 0
    samples = spark.createDataFrame([(i, str(i)) for i in range(300)], "s long, k string")
    with pytest.raises(ValueError):
        x.one_hot_design(samples, "s", ["k"])
    assert x.edge_overlap(values.select(F.col("gene").alias("src"), F.col("gene").alias("dst")), values.select(F.col("gene").alias("src"), F.col("gene").alias("dst"))).first().jaccard == 0.0
