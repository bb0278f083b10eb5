import hashlib

import duckdb
from pyspark.sql import functions as F

from spectrafold.llm import fill_in_middle as fim

TEXTS = [None, "", "a", "plain words\nof a text", "größe ünï 漢字 🙂 tail", "has <P> inside", "<M>", "< P > no <s>", "é" * 70000 + "b🙂" * 70000, "x" * 300000, "é combining ́", "tab\t\x00nul"]
ROWS = [(17 * k + j, text) for k, text in enumerate(TEXTS) for j in range(8)] + [(3, "twice"), (3, "twice"), (None, "no id"), (-5, "below zero")]
ORDER = lambda r: (r[0] is None, r[0] or 0, r[5])


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "pieces": F.lit(1), "form": F.lit(None).cast("string"), "id": F.lit("x")})


def found(spark, frame):
    return fim.stream_digests(fim.piece_tables(frame), {"output_sha256": "pieces", "restored_sha256": "restored"}, ["doc_id", "n", "form", "prefix_chars", "middle_chars"])


def test_against_brute_force(spark):
    want = sorted((fim.brute_force(*r) for r in ROWS), key=ORDER)
    assert sorted(map(tuple, found(spark, docs(spark)).collect()), key=ORDER) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_rendered_texts_restore(spark):
    made = fim.fill_in_middle(docs(spark)).withColumn("back", fim.restore_text(F.col("output"), F.col("form"))).collect()
    want = {r: fim.brute_force(*r) for r in ROWS}
    by = sorted((r.doc_id is None, r.doc_id or 0, r.back) for r in made)
    assert by == sorted((i is None, i or 0, t or "") for i, t in ROWS)
    assert {hashlib.sha256(r.output.encode()).hexdigest() for r in made} == {w[5] for w in want.values()}
    for r in made:
        assert sum(p.length for p in r.pieces if p.buffer == "text") == r.n


def test_sql(spark, tmp_path):
    frame = docs(spark).select("doc_id", "text").where(~F.coalesce(F.contains("text", F.lit("\x00")), F.lit(False)))
    frame.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(fim.OP11_SQL).fetchall(), key=ORDER) == sorted(map(tuple, found(spark, frame).collect()), key=ORDER)


def test_empty_table(spark):
    assert found(spark, docs(spark, [])).count() == 0
