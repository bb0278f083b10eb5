"""Slices read only their blocks; parsers of nested values; formats by first bytes."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.sources import readers as r
from spectrafold.sources import sparse as sp


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = random.Random(1)
    cells = [(f"r{draw.randrange(60):03}", f"c{draw.randrange(40):03}", float(draw.randint(-3, 5))) for _ in range(900)] + [(None, "c001", 1.0), ("r001", None, 1.0)]
    folder = str(tmp_path_factory.mktemp("m") / "matrix")
    sp.write_matrix(spark.createDataFrame(cells, "row string, column string, value double").repartition(4), folder, 10, 8)
    dense = {}
    for a, b, x in cells:
        if a and b:
            dense[a, b] = dense.get((a, b), 0.0) + x
    return folder, dense, sorted({a for a, _ in dense}), sorted({b for _, b in dense})


def got(df):
    return {(x.row, x.column): x.value for x in df.collect()}


def test_slices(spark, stored):
    folder, dense, rows, columns = stored
    full = {k: x for k, x in dense.items() if x}
    assert sp.shape(spark, folder) == (len(rows), len(columns)) and got(sp.read_slice(spark, folder)) == full
    assert got(sp.read_slice(spark, folder, range(10, 25), range(3, 9))) == {k: x for k, x in full.items() if k[0] in rows[10:25] and k[1] in columns[3:9]}
    assert got(sp.read_slice(spark, folder, ["r003", "r041", "nowhere"], None)) == {k: x for k, x in full.items() if k[0] in ("r003", "r041")}
    named = spark.createDataFrame([("c000",), ("c039",), ("c000",)], "k string")
    assert got(sp.read_slice(spark, folder, None, named)) == {k: x for k, x in full.items() if k[1] in ("c000", "c039")}
    assert got(sp.read_slice(spark, folder, [], None)) == {} == got(sp.read_slice(spark, folder, range(5, 5)))
    with pytest.raises(ValueError):
        sp.read_slice(spark, folder, range(0, 9, 2))


def test_only_the_blocks_asked_for_are_read(spark, stored, tmp_path):
    """All other blocks of a copy are no Parquet files any more; the slice doesn't notice."""
    folder, dense, rows, columns = stored
    copy = shutil.copytree(folder, tmp_path / "copy")
    spoiled = [f for f in (copy / "cells").rglob("*.parquet") if "row_block=0/column_block=1" not in str(f)]
    for f in spoiled:
        f.write_bytes(b"spoiled" * 10)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    part = sp.read_slice(spark, str(copy), range(0, 10), range(8, 16))
    assert len(spoiled) > 10 and got(part) == {k: x for k, x in dense.items() if x and k[0] in rows[:10] and k[1] in columns[8:16]}
    assert "PartitionFilters: [isnotnull(row_block" in part._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="(?i)parquet"):
        sp.read_slice(spark, str(copy), range(0, 20), range(8, 16)).collect()


def test_sampled_variance(spark, stored):
    folder, dense, rows, columns = stored
    matrix = np.array([[dense.get((a, b), 0.0) for b in columns] for a in rows])
    out = {x.column: x for x in sp.sampled_variance(spark, folder, 1000).collect()}
    assert all(np.isclose(out[b].mean, matrix[:, j].mean()) and np.isclose(out[b].variance, matrix[:, j].var()) for j, b in enumerate(columns))
    some = {x.column: x.variance for x in sp.sampled_variance(spark, folder, 20, ["c001", "c002"]).collect()}
    assert set(some) == {"c001", "c002"} and some == {x.column: x.variance for x in sp.sampled_variance(spark, folder, 20, ["c001", "c002"]).collect()}


BIB = """% a comment
@comment{nothing, to = {see}}
@Article{one,
  title = {The {RNA} of {a {deep} nest}},
  author = "M{\\"u}ller, A and {Group, The}",
  year = 2001,
  month = jan
}
@book{two, title={Short}, note = "a, b = c", title = {Last
   of two}}

@misc{three,}
@misc{four
}
"""


def test_bibtex_values(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    found = {x.key: x for x in r.bibtex(spark, str(tmp_path / "a.bib")).collect()}
    assert set(found) == {"one", "two", "three", "four"} and found["one"].kind == "article"
    assert found["one"].fields == {"title": "The {RNA} of {a {deep} nest}", "author": 'M{\\"u}ller, A and {Group, The}', "year": "2001", "month": "jan"}
    assert found["two"].fields == {"title": "Last of two", "note": "a, b = c"} and found["three"].fields == {}


def test_formats_by_first_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    df.write.parquet(f"{tmp_path}/one")
    df.write.orc(f"{tmp_path}/two")
    df.write.csv(f"{tmp_path}/three")
    assert sorted(map(tuple, r.read_table(spark, f"{tmp_path}/one", ["v", "k", "x"]).collect()), key=str) == [("a", 1), (None, 2)]
    assert r.read_table(spark, f"{tmp_path}/two").count() == 2
    with pytest.raises(ValueError):
        r.read_table(spark, f"{tmp_path}/three")
    with pytest.raises(ValueError):
        r.read_table(spark, f"{tmp_path}/nowhere")
