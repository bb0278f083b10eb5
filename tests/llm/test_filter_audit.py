import random

import duckdb
from pyspark.sql import functions as F

from spectrafold.llm.filter_audit import OP12_SQL, audit, brute_force, failures, masks

LONG = " ".join(f"w{i}" for i in range(250))
TEXTS = [None, "", " \n\t ", "few words", "A b", "cost $5", LONG, "\x0b" + LONG + "\r\n", "same " * 400, LONG + " UPPER" * 40, LONG + " 100%", "é" * 50 + "ÄÖ", "ab " * 200000, LONG.upper() + " #" + " again" * 600, "x y z " * 70]


def made(seed=0, n=150):
    draw = random.Random(seed)
    docs = [(draw.choice([None, *range(40)]) if draw.random() < 0.2 else 100 + k, draw.choice(TEXTS), draw.choice(["en", "de", None, ""])) for k in range(n)]
    labels = [(draw.choice([d[0] for d in docs]), draw.choice([0, 1, None]), draw.choice([0, 1])) for _ in range(80)]
    return docs + docs[:3], labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit("clash"), "mask": F.lit(None).cast("string"), "toxic": F.lit(7), "id": F.lit(1)})
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))


def test_against_brute_force(spark):
    docs, labels = made()
    got = sorted(map(tuple, audit(masks(*frames(spark, docs, labels))).collect()))
    assert got == brute_force(docs, labels)
    assert len(got) == 600 * 3 and any(r[7] for r in got) and any(r[8] for r in got)


def test_sql(spark, tmp_path):
    docs, labels = made(1, 60)
    con = duckdb.connect()
    for name, frame in zip(("documents", "labels"), frames(spark, docs, labels)):
        frame.select("doc_id", *(("text", "lang") if name == "documents" else ("quality", "toxic"))).write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert sorted(con.execute(OP12_SQL).fetchall()) == brute_force(docs, labels)


def test_edges_of_the_failures(spark):
    rows = [("w " * 199 + "a b", 2), ("w" + " w" * 198, 3), (" ".join(f"u{i // 2}" for i in range(200)), 0), ("a" * 97 + "ABC", 1), ("a" * 96 + "ABC", 5), ("|", 9)]
    got = spark.createDataFrame(rows, "text string, want int").withColumn("got", failures(F.col("text"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_empty_tables(spark):
    docs, labels = made(2, 10)
    d, none = frames(spark, docs, labels)
    assert audit(masks(d.limit(0), none)).count() == 0
    assert sorted(map(tuple, audit(masks(d, none.limit(0))).collect())) == brute_force(docs, [])
