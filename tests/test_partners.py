"""Key pairs and partners by hand, sample sizes against published tables."""

import random

import pytest

from spectrafold.operators import partners as p
from spectrafold.operators import power as w


def tables(spark):
    labels = spark.createDataFrame([(f"AAC{i}-1", f"gene{i % 3}", i) for i in range(20)], "cell string, condition string, depth int")
    counts = spark.createDataFrame([(f"AAC{i}.2", *[float(i)] * 60) for i in range(5, 40)] + [("gene1", *[0.0] * 60)], "barcode string, " + ", ".join(f"g{i} double" for i in range(60)))
    return labels, counts


def test_best_pair(spark):
    labels, counts = tables(spark)
    pairs = {(r.left_key, r.right_key): (r.n_left, r.n_right, r.shared, round(r.fraction, 6)) for r in p.key_pairs(labels, counts).collect()}
    assert pairs == {("cell", "barcode"): (20, 36, 15, 0.75), ("condition", "barcode"): (3, 36, 1, round(1 / 3, 6))}
    best = p.best_key_pair(labels, counts).first()
    assert (best.left_key, best.right_key, best.shared) == ("cell", "barcode", 15)
    assert p.best_key_pair(labels, counts, ["condition"]).first().left_key == "condition" and p.best_key_pair(labels, counts, ["depth"]).first() is None
    assert p.join_halves(labels, counts).count() == 15
    with pytest.raises(ValueError):
        p.join_halves(labels, counts.where("g0 > 1000"))
    assert p.key_pairs(labels.limit(0), counts).count() == 0 and p.long_keys(counts.select("g0")).count() == 0


def test_partner(spark):
    labels, counts = tables(spark)
    half = counts.where("g0 < 10")
    assert p.choose_partner(labels, {"b": half, "a": counts, "narrow": labels}) == "a"
    assert p.choose_partner(labels, {"b": half}) is None and p.choose_partner(labels, {}) is None
    assert p.choose_partner(labels, {"a": counts}, most_label_columns=0) is None


def test_sample_sizes(spark):
    """Published sizes at a power of 0.8 and a level of 0.05, by Cohen's effects."""
    designs = spark.createDataFrame([(0.1, 3), (0.25, 3), (0.4, 3), (0.25, 4), (None, 3), (0.0, 3), (0.25, 1)], "f double, k int")
    assert [r.n_per_group for r in w.anova_rows(designs, "f", "k").collect()] == [323, 53, 22, 45, None, None, None]
    flat = spark.createDataFrame([(0.02, 3), (0.15, 3), (0.35, 3), (0.15, 5)], "f2 double, p int")
    assert [r.n_rows for r in w.regression_rows(flat, "f2", "p").collect()] == [550, 77, 36, 92]
    tables = spark.createDataFrame([(0.1, 1), (0.3, 1), (0.5, 1), (0.3, 4)], "w double, df int")
    assert [r.n_rows for r in w.chi2_rows(tables, "w", "df").collect()] == [785, 88, 32, 133]


def test_power_by_simulation():
    draw = random.Random(1)
    k, n, f = 3, 12, 0.5
    means = [f * (3 / 2) ** 0.5 * x for x in (-1, 0, 1)]
    hits = 0
    for _ in range(3000):
        groups = [[draw.gauss(m, 1) for _ in range(n)] for m in means]
        own = [sum(g) / n for g in groups]
        grand = sum(own) / k
        between, within = n * sum((m - grand) ** 2 for m in own) / (k - 1), sum((x - m) ** 2 for g, m in zip(groups, own) for x in g) / (k * n - k)
        hits += between / within > 3.2849  # the F quantile of 0.95 at 2 and 33
    assert abs(hits / 3000 - w.f_power(k - 1, k * n - k, f * f * k * n, 0.05)) < 0.03
