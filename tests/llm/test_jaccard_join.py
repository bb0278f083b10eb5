import random

from pyspark.sql import functions as F

from spectrafold.llm import jaccard_join
from spectrafold.llm._store import Scratch
from spectrafold.llm.components import connected_components
from spectrafold.llm.jaccard_join import brute_force, jaccard_components


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 60))
    rows = []
    passage = [word() for _ in range(50)]
    for i in range(40):
        rows.append([word() for _ in range(rng.randint(1, 120))] + (passage if i % 3 == 0 else []))
    base = [word() for _ in range(90)]
    for _ in range(60):  # near copies of one text, and chains of them
        base = base if rng.random() < 0.7 else [w if rng.random() > 0.02 else word() for w in base]
        rows.append([w if rng.random() > 0.01 else word() for w in base])
    texts = [" ".join(r) for r in rows]
    texts += [texts[0], texts[0].upper(), "", "  \n", None, "a b c", "A\tb\x0bc", "a b", "x " * 30000, "x " * 29990]
    return list(enumerate(texts, 1))


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("token", F.lit("clash"))
    got = sorted(map(tuple, jaccard_components(docs).collect()))
    assert got == sorted(brute_force(rows))
    assert len({c for _, _, c in got}) < len(rows) - 30


def test_kin_by_their_differences(spark, monkeypatch):
    """Large groups around one text, of which many are no links of it: replaced, dropped and inserted runs of words, some of them shared."""
    monkeypatch.setattr(jaccard_join, "LARGE", 3)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        twice = [word() for _ in range(12)]
        for k in range(30):
            said = list(base)
            for _ in range(rng.randint(0, 4)):
                at, size, kind = rng.randrange(len(said)), rng.randint(1, 4), rng.randrange(4)
                said[at : at + size] = [word() for _ in range(size)] if kind == 0 else [] if kind == 1 else said[at : at + size] + [word() for _ in range(size)] if kind == 2 else twice[:size]
            if k % 5 == 0:
                said[40:52] = twice
            rows.append(" ".join(said))
    rows = list(enumerate(rows, 1))
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute_force(rows))


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = jaccard_components(docs).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = dict(map(tuple, connected_components(links, Scratch(spark, "chain")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
