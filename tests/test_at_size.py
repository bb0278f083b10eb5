"""What larger and odder tables than the driver's smallest brought to light, each query against its SQL."""

import math
import random
import shutil
import time
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold import registry
from spectrafold.operators import permutation as p
from spectrafold.operators import selection as s
from spectrafold.operators import vector_search as vs
from spectrafold.sources import sparse as sp

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder of the driver's tables, of which some are replaced by what SQL gives over them; and that SQL's results."""

    def make(**changed):
        con = duckdb.connect()
        for t in ("supplier", "part", "orders", "lineitem"):
            if t in changed:
                con.execute(f"COPY ({changed[t].format(t=f"'{DATA}/{t}.parquet'")}) TO '{tmp_path}/{t}.parquet'")
            else:
                shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        return str(tmp_path), lambda name: con.execute(registry.oracle_sql()[name]).fetchall()

    return make


def test_share_of_a_graph_without_edges(spark, tables):
    """Among more suppliers no two brands are sold together by more than chance."""
    folder, sql = tables(lineitem="SELECT * FROM {t} WHERE l_partkey = (SELECT min(l_partkey) FROM {t})")
    got, (want,) = registry.queries()["graph_overlap"](spark, folder).first(), sql("graph_overlap")
    assert got.edges_first == 0 and math.isnan(got.of_first) and math.isnan(want[4])
    assert tuple(got)[:4] == want[:4] and got.of_second == want[5]


def test_welch_of_more_rows_than_integers_square(spark):
    """Of 200,000 rows the squares of the counts are no integers any more."""
    df = spark.range(200_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    got = {r.draw: r.statistic for r in p.label_permutations(df, "id", "v", F.col("id") % 2 == 0, 2, "welch_t").collect()}
    side = lambda k: df.where(F.col("id") % 2 == k).agg(F.avg("v"), F.var_samp("v")).first()
    (a, va), (b, vb) = side(0), side(1)
    assert math.isclose(got[0], (a - b) / math.sqrt((va + vb) / 100_000), rel_tol=1e-9) and len(got) == 3 and None not in got.values()


def test_many_blocks_share_folders(spark, tmp_path, monkeypatch):
    """A matrix of 30 blocks in at most 6 folders has the same slices."""
    monkeypatch.setattr(sp, "FOLDERS", 6, raising=False)
    cells = {(a, b): float(a * b % 7 - 3) for a in range(60) for b in range(0, 40, 1 + a % 3)}
    folder = str(tmp_path / "m")
    sp.write_matrix(spark.createDataFrame([(a, b, v) for (a, b), v in cells.items()] + [(5, 5, 1.0), (None, 1, 1.0)], "row int, column int, value double"), folder, 10, 8)
    cells[5, 5] = cells.get((5, 5), 0.0) + 1.0
    assert 1 < len(list((tmp_path / "m" / "cells").glob("row_block=*/column_block=*"))) <= 6 and sp.shape(spark, folder) == (60, 40)
    for rows, columns in ((None, None), (range(10, 25), range(3, 9)), (range(59, 60), None), ([3, 41], range(0, 40))):
        want = {k: v for k, v in cells.items() if v and (rows is None or k[0] in rows) and (columns is None or k[1] in columns)}
        assert {(r.row, r.column): r.value for r in sp.read_slice(spark, folder, rows, columns).collect()} == want


def test_titles_of_few_syllables(spark, monkeypatch):
    """Of 5,000 titles that share nearly all character pairs the like ones are found within a minute, over the borders of chunks too."""
    monkeypatch.setattr(s, "CHUNK", 300, raising=False)
    draw = random.Random(4)
    titles = {"".join(draw.choice(["tion", "th", "and ", "er", "ous", "in ", "re"]) for _ in range(draw.randint(12, 20))) for _ in range(4500)}
    titles = sorted(titles | {t[:k] + "é" + t[k + draw.randint(0, 4) :] for t in draw.sample(sorted(titles), 500) for k in [draw.randrange(len(t))]} | {"x", "xy", "é" * 3000, "é" * 2990})
    begun = time.monotonic()
    got = {(r.key, r.other): r.ratio for r in s.similar_titles(spark.createDataFrame([(t,) for t in titles], "t string").repartition(4), "t").collect()}
    assert time.monotonic() - begun < 60
    for a in [*draw.sample(titles, 25), "é" * 3000, "x"]:
        like = {b: SequenceMatcher(None, a, b).ratio() for b in titles if b != a and SequenceMatcher(None, a, b).real_quick_ratio() >= 0.9 and SequenceMatcher(None, a, b).quick_ratio() >= 0.9}
        assert {b: r for (k, b), r in got.items() if k == a} == {b: r for b, r in like.items() if r >= 0.9}


def test_neighbours_by_blocks(spark, monkeypatch):
    """Equal vectors in other blocks are equally near, so that ids decide between them."""
    monkeypatch.setattr(vs, "PIECE", 40)
    draw = np.random.default_rng(3)
    x = draw.standard_normal((400, 7))
    x[200:] = x[draw.integers(0, 50, 200)]
    got = vs.scan(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>"), F.col("id") % 10 == 0, 5).collect()
    near = lambda a, b: sum(map(float.__mul__, a, b), 0.0) / (math.sqrt(sum(map(float.__mul__, a, a), 0.0)) * math.sqrt(sum(map(float.__mul__, b, b), 0.0)))
    for q in range(0, 400, 10):
        best = sorted((-r.s, r.vec_id) for r in got if r.query_id == q)[:5]
        want = sorted((-near(x[q].tolist(), v.tolist()), i) for i, v in enumerate(x) if i != q)[:5]
        assert [i for _, i in best] == [i for _, i in want] and np.allclose([s for s, _ in best], [s for s, _ in want], rtol=1e-12)
