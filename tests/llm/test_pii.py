from pyspark.sql import functions as F

from spectrafold.llm import pii as p
from spectrafold.llm._spans import listed, said

TRICKY = [
    "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.2.3.256",
    "4111 1111 1111 1111 0 4111-1111-1111-1111",
    "+1 (555) 123-4567 ++49.30.1234567890- +1",
    "9" * 50000,
    "a" * 60000 + "@x.y",
    "1 " * 30000,
    "é@b.cd 4111  1111 1111 1111 +49 30 1234567",
    "+1" + " " * 5000 + "2",
    "a@b.c..d@e-.f@g.h 1.1.1.1111111111111111111111111",
]


def test_base_spans(spark):
    rows = [*enumerate(TRICKY), (90, None), (91, ""), (92, TRICKY[0]), (92, TRICKY[0]), (92, "other x@y.z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("email", F.lit("clash"))
    got = p.find_personal_data(docs).select("doc_id", said(listed({k: F.col(k) for k in p.KINDS[:4]}), p.KINDS).alias("base")).collect()
    assert sorted(map(tuple, got)) == sorted((i, ",".join(f"{k}:{a}:{b}" for k, a, b in p.brute_force(t))) for i, t in rows)
    assert p.find_personal_data(docs.limit(0)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"Report {i}: Zorblatt can be reached under zed@corp.example on day {i}.") for i in range(6)]
    rows += [(10 + i, f"Common words about day {i} and reached goals under the sun.") for i in range(200)]
    rows += [(300, "Zorblatt was seen without an address.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in p.sanitise(docs).collect()}
    assert got[0].text == "Report 0:  can be reached under [EMAIL] on day 0." or "Zorblatt" not in got[0].text
    assert "Zorblatt" not in got[300].text and "zed@corp" not in got[1].text
    assert got[11].text == rows[7][1]
