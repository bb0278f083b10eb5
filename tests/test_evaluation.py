"""Curve areas, class metrics and per-gene tests against direct counts."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from spectrafold.operators import evaluation as e
from spectrafold.operators.expression import differential_expression, expression_summary
from spectrafold.operators.statistics import benjamini_hochberg, holm


def areas(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    if not pos or not neg:
        return None, None
    auroc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap, seen = 0.0, 0
    for t in sorted(set(pos), reverse=True):
        hits = sum(p >= t for p in pos)
        ap += (hits - seen) / len(pos) * hits / (hits + sum(n >= t for n in neg))
        seen = hits
    return auroc, ap


def test_ranking_metrics(spark):
    draw = random.Random(1)
    rows = [(draw.choice("abc"), draw.random() < 0.4, float(draw.randint(0, 12))) for _ in range(300)] + [("one", True, 1.0), ("one", True, 2.0), ("two", False, 0.0), (None, True, 1.0), (None, False, 0.5)]
    gaps = [("a", None, 1.0), ("a", True, None), ("b", False, float("nan"))]
    df = spark.createDataFrame(rows + gaps, "k string, y boolean, s double").withColumns({"g": F.lit("clash"), "part": F.lit(1)})
    got = {r.k: r for r in e.ranking_metrics(df, F.col("y"), F.col("s"), ["k"]).collect()}
    for k in {r[0] for r in rows}:
        want = areas([(y, s) for g, y, s in rows if g == k])
        assert all(a is b is None or math.isclose(a, b, rel_tol=1e-12) for a, b in zip((got[k].auroc, got[k].auprc), want)), k
    assert got["one"].auroc is None and got["two"].auprc is None and got[None].auroc == 1.0
    whole = e.ranking_metrics(df, F.col("y"), F.col("s")).first()
    assert math.isclose(whole.auroc, areas([r[1:] for r in rows])[0], rel_tol=1e-12)
    assert e.ranking_metrics(df.limit(0), F.col("y"), F.col("s")).count() == 0


def test_probability_metrics(spark):
    draw = random.Random(2)
    rows = [(draw.choice("xyz"), *(round(draw.random(), 1) for _ in range(3))) for _ in range(200)]
    df = spark.createDataFrame(rows, "label string, x double, y double, z double")
    got = e.probability_metrics(df, "label", {c: F.col(c) for c in "xyz"}).first()
    said = ["xyz"[max(range(3), key=lambda i: (r[1 + i], -i))] for r in rows]
    recall = [np.mean([p == k for p, r in zip(said, rows) if r[0] == k]) for k in "xyz"]
    f1 = [2 * sum(p == r[0] == k for p, r in zip(said, rows)) / (said.count(k) + sum(r[0] == k for r in rows)) for k in "xyz"]
    assert math.isclose(got.accuracy, np.mean([p == r[0] for p, r in zip(said, rows)])) and math.isclose(got.balanced_accuracy, np.mean(recall)) and math.isclose(got.macro_f1, np.mean(f1))
    each = [areas([(r[0] == k, r[1 + i]) for r in rows]) for i, k in enumerate("xyz")]
    assert math.isclose(got.macro_auroc, np.mean([a for a, _ in each])) and math.isclose(got.macro_auprc, np.mean([b for _, b in each])) and got.undefined == []
    lacking = e.probability_metrics(df.where("label <> 'z'"), "label", {c: F.col(c) for c in "xyz"}).first()
    assert lacking.macro_auroc is None and lacking.macro_auprc is None and lacking.undefined == ["z"]


def test_averages(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1), (None, 1)]
    df = spark.createDataFrame(rows, "t int, p int")
    binary = e.classification_summary(df, "t", "p", "binary").first()
    assert (binary.n, binary.n_classes) == (6, 2) and math.isclose(binary.precision, 2 / 3) and math.isclose(binary.recall, 2 / 3) and math.isclose(binary.accuracy, 4 / 6)
    three = df.unionByName(spark.createDataFrame([(2, 0), (2, 2)], "t int, p int"))
    assert math.isclose(e.classification_summary(three, "t", "p", "binary").first().recall, e.classification_summary(three, "t", "p", "weighted").first().recall)
    micro = e.classification_summary(three, "t", "p", "micro").first()
    assert micro.precision == micro.recall == micro.accuracy
    macro = e.classification_summary(three, "t", "p", "macro").first()
    assert math.isclose(macro.precision, np.mean([2 / 4, 2 / 3, 1.0]))


def test_differential_expression(spark):
    draw = random.Random(3)
    samples = [(f"s{i}", "case" if i < 6 else "control" if i < 11 else "other") for i in range(14)]
    dense = {(f"g{g}", s): draw.choice([0, 0, draw.randint(1, 40), g * (k == "case")]) for g in range(30) for s, k in samples}
    dense |= {("flat", s): 8 for s, _ in samples} | {("step", s): 31 if k == "case" else 7 for s, k in samples} | {("rare", s): 0 for s, _ in samples} | {("rare", "s0"): 3} | {("away", "s12"): 50}
    cells = [(s, g, float(v)) for (g, s), v in dense.items() if v] + [("s0", "g1", 0.0), ("s0", None, 9.0), ("unknown", "g2", 4.0)]
    split = [(s, g, v / 2) for s, g, v in cells for _ in range(2)]
    frame = lambda rows: spark.createDataFrame(rows, "sample string, gene string, value double").withColumns({"x": F.lit("clash"), "side": F.lit(0)})
    told = differential_expression(frame(split), spark.createDataFrame(samples, "sample string, k string"), "sample", "gene", "value", "k", "case", "control").cache()
    got = {r.gene: r for r in told.collect()}
    genes = [g for g in {g for g, _ in dense} if sum(v for (h, _), v in dense.items() if h == g) + (4 if g == "g2" else 0) >= 10]
    assert set(got) == set(genes) and "rare" not in got and "away" in got
    for g in genes:
        a, b = (np.array([dense.get((g, s), 0) for s, k in samples if k == side], float) for side in ("case", "control"))
        la, lb = np.log2(a + 1), np.log2(b + 1)
        assert math.isclose(got[g].log2_fold_change, la.mean() - lb.mean(), abs_tol=1e-9) and math.isclose(got[g].base_mean, np.r_[a, b].mean(), abs_tol=1e-9)
        pooled = (la.var(ddof=1) * 5 + lb.var(ddof=1) * 4) / 9
        if pooled > 1e-12:
            assert math.isclose(got[g].t, (la.mean() - lb.mean()) / math.sqrt(pooled * (1 / 6 + 1 / 5)), rel_tol=1e-7, abs_tol=1e-9)
    assert got["flat"].p is None and got["flat"].adjusted is None and got["step"].p == 0.0 and got["step"].direction == "up" and got["away"].p is None
    known = sorted((r.p, r.gene) for r in got.values() if r.p is not None)
    want, least = {}, 1.0
    for k in range(len(known), 0, -1):
        least = min(least, known[k - 1][0] * len(known) / k)
        want[known[k - 1][1]] = least
    assert all(math.isclose(got[g].adjusted, q, rel_tol=1e-9) for g, q in want.items())
    summary = expression_summary(told).first()
    assert summary.n_tested == len(genes) and summary.n_significant == sum(r.significant for r in got.values()) == summary.n_up + summary.n_down
    assert differential_expression(frame(split), spark.createDataFrame([("s0", "case")], "sample string, k string"), "sample", "gene", "value", "k", "case", "control").count() == 0


def test_corrections_run_over_ranges(spark):
    draw = random.Random(4)
    ps = sorted(draw.random() ** 3 for _ in range(200))
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").repartition(5)
    bh = {r.i: r.adjusted for r in benjamini_hochberg(df, monotone=True).collect()}
    down = {r.i: r.adjusted for r in holm(df).collect()}
    for i, p in enumerate(ps):
        assert math.isclose(bh[i], min(1, *(q * 200 / (k + 1) for k, q in enumerate(ps) if k >= i)))
        assert math.isclose(down[i], max(min(1, q * (200 - k)) for k, q in enumerate(ps) if k <= i))
