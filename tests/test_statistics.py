import math

import pytest

from spectrafold.functions import distributions as dist
from spectrafold.operators import statistics as s


@pytest.fixture(scope="module")
def ps(spark):
    return spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "id int, p double")


def test_corrections(ps):
    bh = {r.id: r for r in s.benjamini_hochberg(ps).collect()}
    assert [bh[i].significant for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert [round(bh[i].adjusted, 4) for i in (1, 3, 2, 4)] == [0.04, 0.06, 0.0533, 0.5]
    assert [round(r.adjusted, 4) for r in s.benjamini_hochberg(ps, monotone=True).orderBy("rank").collect()] == [0.04, 0.0533, 0.0533, 0.5]
    assert [r.significant for r in s.holm(ps).orderBy("id").collect()] == [True, False, False, False]
    assert [r.significant for r in s.bonferroni(ps).orderBy("id").collect()] == [True, False, False, False]


def test_chi_square(spark):
    cells = [("a", "x", 70), ("a", "y", 30), ("b", "x", 40), ("b", "y", 60)]
    df = spark.createDataFrame([(r, c) for r, c, n in cells for _ in range(n)], "r string, c string")
    assert round(s.chi_square(df, "r", "c", yates=False).first().chi2, 4) == 18.1818
    got = s.chi_square(df, "r", "c").first()
    assert round(got.chi2, 4) == 16.9899 and round(got.cramers_v, 4) == 0.2915 and got.dof == 1


def test_t_and_anova_agree(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(30)] + [("b", float(i % 5) + 1) for i in range(25)], "g string, v double")
    t, f = s.t_test(df, "g", "v", "a", "b").first(), s.anova(df, "g", "v").first()
    assert math.isclose(t.t**2, f.f, rel_tol=1e-9)
    p = spark.createDataFrame([(t.t, float(t.df), f.f, 1.0)], "t double, df double, f double, one double")
    r = p.select(dist.t_two_sided("t", "df").alias("a"), dist.f_upper("f", "one", "df").alias("b")).first()
    assert math.isclose(r.a, r.b, rel_tol=1e-9)


def test_flat_data_has_no_effect(spark):
    df = spark.createDataFrame([("a", 5.0)] * 4 + [("b", 5.0)] * 4, "g string, v double")
    got = s.t_test(df, "g", "v", "a", "b").first()
    assert got.t is None and got.cohens_d == 0
    assert s.anova(df, "g", "v").first().f is None
    assert s.linear_fit(df.withColumn("w", df.v), "v", "w").first().slope is None


def test_distributions():
    assert math.isclose(float(dist.incomplete_beta(5.0, 0.5, 10 / (10 + 2.228138852**2))), 0.05, rel_tol=1e-6)
    assert math.isclose(float(dist.upper_gamma(0.5, 3.841458821 / 2)), 0.05, rel_tol=1e-7)
    assert math.isclose(float(dist.upper_gamma(5.0, 18.30703805 / 2)), 0.05, rel_tol=1e-7)


def test_ranks_and_u(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    assert sorted(r.mid_rank for r in s.mid_ranks(df, "v").collect()) == [1.0, 3.0, 3.0, 3.0, 5.0]
    assert s.mann_whitney(df, "g", "v", "a", "b").first().u == 1.0


def test_describe(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (float("nan"),), (None,)], "v double")
    r = s.describe(df, "v").first()
    assert (r.n, r.n_missing, r.mean, r.median, r.q1, r.q3, r.range) == (4, 2, 2.5, 2.5, 1.75, 3.25, 3.0)
