"""Screen labels, splits and responses by hand and by dense arrays."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import screens as s


def test_labels(spark):
    rows = [
        ("CBL+CNN1", ["CBL", "CNN1"], False), ("CBL_CNN1", ["CBL", "CNN1"], False), ("A_B+C", ["A_B", "C"], False), ("UBL5+ctrl", ["UBL5"], False), ("ctrl+ctrl", ["ctrl", "ctrl"], False), ("ARMCX5-GPRASP2", ["ARMCX5-GPRASP2"], False),
        ("a;;b;", ["a", "b"], False), ("", [], False), (None, [], False), ("  ", [], False), (" Ctrl ", ["Ctrl"], True), ("NT", ["NT"], True), ("NTg5", ["NTg5"], True), ("eGFPg1", ["eGFPg1"], True), ("egfp", ["egfp"], False), ("NTS", ["NTS"], False), ("NT5E", ["NT5E"], False), ("control_ctrl", ["control", "ctrl"], True), ("lacZ12", ["lacZ12"], True),
    ]
    got = spark.createDataFrame([(a,) for a, _, _ in rows], "t string").select(s.condition_genes(F.col("t")).alias("g"), s.is_control(F.col("t")).alias("c")).collect()
    want = [(["control"] if a == "control_ctrl" else g, c) for a, g, c in rows]
    assert [(r.g, r.c) for r in got] == want


def test_guides(spark):
    known = spark.createDataFrame([("ATF2",), ("IRFg1",), (None,), ("ATF2",)], "symbol string")
    rows = [("ATF2g1", "ATF2"), ("ATF2_g2", "ATF2"), ("ATF2-G3", "ATF2"), ("ATF2", "ATF2"), ("IRFg1", "IRFg1"), ("NEWg1", "NEWg1"), (" ATF2g1 ", "ATF2"), ("g1", "g1"), ("", ""), (None, None)]
    got = s.perturbed_genes(spark.createDataFrame([(a,) for a, _ in rows], "t string"), "t", known, "symbol").collect()
    assert sorted(((r.t, r.perturbed) for r in got), key=str) == sorted(rows, key=str)


def splits(names, mode, test=0.2, validation=0.1, seed="1", holdout=()):
    out, rest = {}, {"one": [], "several": []}
    for c in names:
        if c in holdout:
            out[c] = "test"
        else:
            rest["several" if "+" in c else "one"].append(c)
    drawn = {"unseen_single": ["one"], "unseen_combination": ["several"], "mixed": ["one", "several"]}[mode]
    h = lambda c: (hashlib.md5(f"{seed}:{c}".encode()).hexdigest(), c)
    for pool, cs in rest.items():
        cs = sorted(cs, key=h)
        t = round(len(cs) * test) if pool in drawn else 0
        v = round((len(cs) - t) * validation) if pool in drawn else 0
        out |= {c: "test" if i < t else "validation" if i < t + v else "train" for i, c in enumerate(cs)}
    train = [c for c, x in out.items() if x == "train"]
    if "validation" not in out.values() and len(train) >= 2:
        out[max(train, key=h)] = "validation"
    return out


@pytest.mark.parametrize("mode", ["mixed", "unseen_single", "unseen_combination"])
def test_splits(spark, mode):
    for names, holdout in (([f"g{i}" for i in range(33)] + [f"g{i}+g{i + 1}" for i in range(17)], ["g5", "g1+g2"]), (["a", "b", "c", "d"], []), (["a"], []), ([], [])):
        rows = [(c, k) for c in names for k in range(2)] + [("ctrl", 0), (None, 0), ("", 1), ("NTg1", 2)]
        df = spark.createDataFrame(rows, "c string, k int").withColumns({"pool": F.lit("clash"), "h": F.lit(1), "split": F.lit("x")})
        told = s.identity_split(df, "c", mode, seed="1", holdout=holdout)
        assert {r.condition: r.split for r in told.collect()} == splits(names, mode, holdout=holdout)
        assert s.route(df.drop("split"), "c", told).count() == 2 * len(names)


def test_pools(spark):
    df = spark.createDataFrame([("ctrl", "b1", 1), ("NTg2", None, 2), ("CBL", "b1", 3)], "c string, batch string, k int")
    assert sorted((r.pool, r.k) for r in s.control_pools(df, "c", ["batch"]).collect()) == [("None", 2), ("b1", 1), ("global", 1), ("global", 2)]
    assert s.control_pools(df.where("k = 3"), "c").count() == 0


def test_count_matrices(spark):
    verdict = lambda vs, n=10, g=600, **kw: s.count_matrix_verdict(spark.createDataFrame([(v,) for v in vs], "value double"), n, g, **kw).first()
    assert verdict([1.0, 2.0]).is_counts and verdict([1.0], g=400).reason == "too few columns" and verdict([-1.0]).reason == "negative values"
    assert verdict([1.0] * 4000).reason == "too few zeros" and verdict([1.5] * 2000).reason == "not whole numbers" and verdict([1.5] * 4000, single_cell=True).is_counts
    assert verdict([None] * 6000).reason == "every value is missing" and verdict([], n=0).reason == "every value is missing"


def test_means_of_samples(spark):
    counts = np.array([[3, 0, 1, 0], [0, 0, 0, 0], [5, 2, 0, 1]], float)
    cells = spark.createDataFrame([(i, f"RPL{j}" if j == 1 else f"g{j}", float(counts[i, j]) / 2) for i in range(3) for j in range(4) if counts[i, j] for _ in range(2)], "sample long, gene string, value double")
    total = counts.sum(axis=1, keepdims=True)
    want = np.log1p(counts / np.where(total > 0, total, 1) * 100).mean(axis=0)
    got = {r.gene: r["mean"] for r in s.mean_log_cpm(cells, 3, 100).collect()}
    assert all(math.isclose(got[f"RPL{j}" if j == 1 else f"g{j}"], want[j]) for j in range(4))
    reference = spark.createDataFrame([("g0", 2.0), ("RPL1", 1.0), ("g2", 0.5), ("g3", 0.05), ("zz", 3.0)], "gene string, mean double")
    alike = s.profile_similarity(reference, cells, 3, 100).first()
    assert alike.shared_genes == 3 and math.isclose(alike.pearson, np.corrcoef([2, 1, 0.5], want[:3])[0, 1]) and alike.median_total == 6.0 and alike.median_genes == 2.5 and math.isclose(alike.ribosomal_share, 0.125)
    assert sorted({r.sample for r in s.called_cells(cells, 5).collect()}) == [2]


def frames(spark, *arrays):
    return [spark.createDataFrame([(k, f"g{j:02}", float(v)) for k, row in a.items() for j, v in enumerate(row)], "label string, gene string, value double").withColumn("p", F.lit("clash")) for a in arrays]


def test_responses(spark):
    rng = np.random.default_rng(5)
    observed = {k: np.round(rng.normal(size=12), 1) for k in "abcd"}
    predicted = {k: np.round(v * 0.5 + rng.normal(size=12) * 0.3, 1) for k, v in observed.items() if k != "d"} | {"e": np.ones(12)}
    p, o = frames(spark, predicted, observed)
    got = {r.label: r for r in s.response_metrics(p, o, 5).collect()}
    shared = "abc"
    pm, om = (np.mean([t[k] for k in shared], axis=0) for t in (predicted, observed))
    top = lambda v: set(np.lexsort((np.arange(12), -np.abs(v)))[:5].tolist())
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    r = lambda a, b: np.corrcoef(a, b)[0, 1]
    assert set(got) == set(shared)
    for k in shared:
        x, y, g = predicted[k], observed[k], got[k]
        deg = sorted(top(y))
        want = {"mse": ((x - y) ** 2).mean(), "mse_deg": ((x - y)[deg] ** 2).mean(), "pearson": r(x, y), "pearson_deg": r(x[deg], y[deg]), "pearson_specific": r(x - pm, y - om), "spearman": r(rank(x), rank(y)), "direction_accuracy": np.mean(np.sign(x[deg]) == np.sign(y[deg])), "top_overlap": len(top(x) & top(y)) / 5, "n_deg": 5}
        assert all(math.isclose(g[n], w, abs_tol=1e-9) for n, w in want.items()), k
    signal = s.response_signal(p, o).first()
    spread = lambda t: np.stack([t[k] for k in shared]).std(axis=0).mean()
    assert math.isclose(signal.across, spread(predicted)) and math.isclose(signal.signal, spread(predicted) / spread(observed))
    rest = {(x.label, x.gene): x.value for x in s.reference_responses(o).where("reference LIKE 'mean%'").collect()}
    assert all(math.isclose(rest[k, f"g{j:02}"], np.mean([observed[m][j] for m in observed if m != k]), abs_tol=1e-12) for k in observed for j in range(12))
    flat = s.response_metrics(*frames(spark, {"a": np.zeros(4)}, {"a": np.arange(4.0)}), 9).first()
    assert flat.pearson is None and flat.spearman is None and flat.pearson_specific is None and flat.n_deg == 4


def test_moved_and_retained_genes(spark):
    (df,) = frames(spark, {"a": [0, 3, -3, 1], "b": [0, 0.1, 0, 0]})
    names = lambda d: sorted((r.label, r.gene) for r in d.collect())
    assert names(s.moved_genes(df, top=1)) == [("a", "g01"), ("b", "g01")]
    assert names(s.moved_genes(df, threshold=2.0)) == [("a", "g01"), ("a", "g02"), ("b", "g01")]
    assert names(s.moved_genes(df)) == [("a", "g01"), ("a", "g02"), ("a", "g03"), ("b", "g01")]
    cells = spark.createDataFrame([(1, "g1", 2.0), (2, "g1", -2.0), (2, "g2", 1.0), (3, "g2", 1.0)], "sample long, gene string, value double")
    labels = spark.createDataFrame([(1, "x"), (2, "x")], "sample long, label string")
    assert names(s.retained_genes(cells, labels)) == [("x", "g2")]
