"""Every registered query against its SQL on the smallest tables, and the entry module without the optional parts."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from spectrafold import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=str)


def same(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)) for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(rows(got), rows(want))


def test_entry_without_optional_parts():
    code = "import sys; sys.modules['spectrafold.llm'] = None; sys.modules['spectrafold.llm.catalog'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert list(map(int, said.stdout.split())) == [len(registry.queries()), len(registry.oracle_sql())]
