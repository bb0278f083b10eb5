import hashlib
import math
import random

from pyspark.sql import functions as F

from spectrafold.operators import permutation as p


def by_sorting(rows, draws, statistic):
    rows = [(str(i), v, g) for i, v, g in rows if v is not None and g is not None]
    k = sum(g for *_, g in rows)

    def value(a, b):
        if not a or not b:
            return None
        mean = lambda x: sum(x) / len(x)
        gap = mean(a) - mean(b)
        if statistic == "mean_difference":
            return gap
        error = sum(sum((y - mean(x)) ** 2 for y in x) / (len(x) - 1) / len(x) for x in (a, b))
        return gap / math.sqrt(error)

    out = {0: value([v for _, v, g in rows if g], [v for _, v, g in rows if not g])}
    for b in range(1, draws + 1):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:{b}".encode()).hexdigest(), r[0], r[1]))
        out[b] = value([r[1] for r in order[:k]], [r[1] for r in order[k:]])
    return out


def test_label_permutations_by_sorting(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 3), rng.random() < 0.3) for i in range(3000)] + [(5000, None, True), (5001, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, g boolean").withColumn("draw", F.lit("clash"))
    for last, statistic in ((1000, "mean_difference"), (50, "welch_t"), (1, "welch_t")):
        monkeypatch.setattr(p, "LAST", last)
        permuted = p.label_permutations(df, "id", "x", F.col("g"), 12, statistic)
        got = {r.draw: r.statistic for r in permuted.collect()}
        want = by_sorting(rows, 12, statistic)
        assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-9 for b in want), last
    for how, far in (("two-sided", lambda x: abs(x) >= abs(want[0])), ("greater", lambda x: x >= want[0]), ("less", lambda x: x <= want[0])):
        r = p.empirical_p(permuted, how).first()
        assert r.shuffles == 12 and abs(r.p - (sum(far(want[b]) for b in range(1, 13)) + 1) / 13) < 1e-12


def test_one_label_ties_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(p, "LAST", 2)
    for label in (True, False):
        df = spark.createDataFrame([(i, 1.0, label) for i in range(20)], "id long, x double, g boolean")
        assert [r.statistic for r in p.label_permutations(df, "id", "x", F.col("g"), 3).collect()] == [None] * 4
    # Rows of one id never part by their hash.
    df = spark.createDataFrame([(1, float(i % 2), i < 8) for i in range(20)], "id long, x double, g boolean")
    got = {r.draw: r.statistic for r in p.label_permutations(df, "id", "x", F.col("g"), 3).collect()}
    assert got == {0: 0.5 - 0.5, **dict.fromkeys((1, 2, 3), 0.0 - 10 / 12)}
    empty = p.label_permutations(df.limit(0), "id", "x", F.col("g"), 3)
    assert [r.statistic for r in empty.collect()] == [None] * 4
    assert p.empirical_p(empty).first().shuffles == 0
