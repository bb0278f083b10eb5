import math

import pytest

from spectrafold.operators import inference as i


def test_t_quantiles_of_the_tables():
    for p, df, want in ((0.975, 9, 2.262157), (0.95, 30, 1.697261), (0.995, 4, 4.604095)):
        assert i.t_quantile(p, df) == pytest.approx(want, abs=1e-5)


def test_mean_interval(spark):
    rows = [(float(v),) for v in range(10)]
    r = i.mean_interval(spark.createDataFrame(rows, "v double"), "v").first()
    half = 2.262157 * math.sqrt(55 / 6) / math.sqrt(10)
    assert (r.n, r.mean) == (10, 4.5) and r.low == pytest.approx(4.5 - half, abs=1e-4) and r.high == pytest.approx(4.5 + half, abs=1e-4)


def test_shuffles_keep_the_values(spark):
    df = spark.createDataFrame([(k, k % 3, float(k)) for k in range(40)], "id int, g int, v double")
    got = i.shuffled(df, "id", ["g", "v"], "1").collect()
    assert sorted(r.v for r in got) == [float(k) for k in range(40)] and sorted(r.g for r in got) == sorted(k % 3 for k in range(40))
    assert any(r.v != r.id for r in got)
