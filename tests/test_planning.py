"""Roles and shared columns of tables by hand; vector search against a full scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import planning as p
from spectrafold.operators import vector_search as v


def tables(spark):
    draw = random.Random(1)
    make = lambda names, n, *more: spark.createDataFrame([tuple([draw.random() for _ in names] + list(more)) for _ in range(n)], ", ".join([f"`{c}` double" for c in names] + [f"m{i} string" for i in range(len(more))]))
    gold = make(["Age", "height", "weight", "bmi"], 30).withColumn("outcome", F.lit("x"))
    return {
        "gold": gold,
        "mirror": gold.repartition(4),
        "small": make(["age"], 5).withColumn("outcome", F.lit("y")),
        "wide": make(["age", "Height", "WEIGHT", "zip"], 9),
        "other": make(["bmi", "weight", "age"], 9),
        "clash": make(["bmi", "height"], 9).withColumn("zz", F.lit(1)),
        "twice": make(["we.ight", "weight.", "age"], 4),
        "one": make(["age"], 3),
        "words": spark.createDataFrame([(f"w{i}", None) for i in range(60)], "a string, b double"),
        "rows": make(["index", "age", "height"], 4).select("index", "age", "height"),
    }


def test_roles(spark):
    plan = {r.table: r for r in p.assemble_plan(p.signatures(tables(spark)), "outcome").collect()}
    said = {t: (r.role, r.reason) for t, r in plan.items()}
    assert said["gold"] == ("gold", "primary") and said["mirror"] == ("unusable", "mirror of the primary table")
    assert said["one"][1] == "not a table" and said["words"][1] == "no usable feature"
    assert said["small"] == ("unusable", "too few shared features") and said["twice"] == ("unusable", "too few shared features")
    # Widest first: other and wide have three shared columns, other comes first by name and leaves wide two of them.
    assert said["other"] == said["wide"] == ("supplementary", "evidence")
    assert said["clash"] == ("unusable", "would narrow the shared features too far") == said["rows"]
    assert plan["gold"].features == ["Age", "height", "weight", "bmi"] and plan["wide"].shared == ["age", "height", "weight"] and plan["rows"].features == ["age", "height"]
    common = p.common_features(p.assemble_plan(p.signatures(tables(spark)), "outcome")).orderBy("position").collect()
    assert [r.feature for r in common] == ["age", "weight"]
    rows = p.pooled_rows({t: tables(spark)[t] for t in ("gold", "other", "wide")}, ["age", "weight"])
    assert rows.columns == ["age", "weight", "origin"] and rows.count() == 48
    with pytest.raises(ValueError):
        p.renamed_to(tables(spark)["twice"], ["weight"])


def test_roles_without_target_and_with_a_named_primary(spark):
    sig = p.signatures(tables(spark))
    free = {r.table: r.role for r in p.assemble_plan(sig, "nothing").collect()}
    assert "gold" not in free.values() and free["wide"] == "supplementary" and free["one"] == "unusable"
    pool = {r.table: (r.role, r.reason) for r in p.assemble_plan(sig, "outcome", primary="small", pool=True).collect()}
    assert pool["small"] == ("gold", "primary") and pool["gold"] == ("gold", "pooled")
    with pytest.raises(ValueError):
        p.signatures({})


def test_plain_names(spark):
    got = spark.createDataFrame([("concave points_mean",), (' "Concave-Points.mean"',), ("PISD",), ("ü x",)], "c string").select(p.plain_name(F.col("c"))).collect()
    assert [r[0] for r in got] == ["concave_points_mean", "concave_points_mean", "pisd", "_x"]


def full_scan(rows, asked, k, least=-1.0, skip=lambda q, i: False):
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows if x is not None and np.isfinite(x).all() and np.any(x)}
    out = {}
    for q in asked:
        if q not in unit:
            continue
        best = sorted((-round(float(unit[q] @ unit[i]), 12), i) for i in unit if not skip(q, i))
        out[q] = [(i, -s) for s, i in best if -s >= least][:k]
    return out


def made(seed=3, n=400, dim=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, dim))
    rows = [(i, (centre[i % 7] * 3 + rng.normal(size=dim)).tolist(), i % 3) for i in range(n)]
    rows += [(n + i, rows[5][1], 1) for i in range(4)] + [(n + 10, None, 0), (n + 11, [0.0] * dim, 0), (n + 12, [float("nan")] + [1.0] * (dim - 1), 0)]
    return rows


def test_search_equals_full_scan(spark, monkeypatch):
    monkeypatch.setattr(v, "PIECE", 16)
    rows = made()
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int").withColumns({"q": F.lit("clash"), "query": F.lit(1)})
    index = v.build_index(df.repartition(5), "id", "vec", 12)
    assert index[0].count() == 404
    asked = [i for i, _, _ in rows if i % 20 == 0 or i >= 400]
    queries = df.where(F.col("id").isin(asked))

    def answers(found):
        out = {}
        for r in found.orderBy("query", "rank").collect():
            out.setdefault(r["query"], []).append((r.id, r.similarity))
        return out

    def same(got, want):
        assert set(got) == {q for q, a in want.items() if a}
        for q, a in got.items():
            assert [i for i, _ in a] == [i for i, _ in want[q]] and np.allclose([s for _, s in a], [s for _, s in want[q]])

    same(answers(v.search(index, queries, "id", "vec", 5, "id")), full_scan(rows, asked, 5))
    same(answers(v.search(index, queries, "id", "vec", 3, "id", exclude_self=True)), full_scan(rows, asked, 3, skip=lambda q, i: q == i))
    label = {i: x for i, _, x in rows}
    same(answers(v.search(index, queries, "id", "vec", 4, "id", where=F.col("label") == 1, least=0.6)), full_scan(rows, asked, 4, 0.6, lambda q, i: label[i] != 1))
    seen = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "id long")
    same(answers(v.search(index, queries, "id", "vec", 500, "id", exclude=seen)), full_scan(rows, asked, 500, skip=lambda q, i: i < 300 and i % 2 == 0))
    liked = [7, 14, 21]
    mean = np.mean([rows[i][1] for i in liked], axis=0).tolist()
    want = full_scan([*rows, (-1, mean, 0)], [-1], 6, skip=lambda q, i: i in (*liked, -1))[-1]
    got = v.recommend(index, df.where(F.col("id").isin(liked)), "id", "vec", 6).orderBy("rank").collect()
    assert [r.id for r in got] == [i for i, _ in want]


def test_search_of_nothing(spark):
    df = spark.createDataFrame(made(1, 20), "id long, vec array<double>, label int")
    index = v.build_index(df, "id", "vec")
    assert v.search(index, df.limit(0), "id", "vec", 3, "id").count() == 0
    assert v.search(index, df, "id", "vec", 3, "id", where=F.col("label") > 9).count() == 0
    assert v.search(v.build_index(df.limit(0), "id", "vec"), df, "id", "vec", 3, "id").count() == 0
