import base64
import hashlib

from pyspark.sql import functions as F

from spectrafold.llm import warc


def brute_force(rows, least=0):
    last = {}
    for page, _, html in rows:
        data = (html or "").encode()
        last[data] = max(last.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and last[data] != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last[data] if again else None))
    return sorted(out)


ROWS = [
    (1, "http://a", "<p>x</p>"),
    (2, "http://b", "<p>x</p>"),
    (9, None, "<p>x</p>"),
    (3, "http://c\r\nX: y", None),
    (4, "http://d", ""),
    (5, "http://e", "ünï\r\n\r\nWARC-Type: revisit\r\nContent-Length: 7\r\n\r\n"),
    (6, "http://f", "z" * 300000),
    (7, "http://f", "z" * 300000),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("payload", F.lit(1))
    for least in (0, 20):
        folder = f"{tmp_path}/{least}"
        warc.write_archive(pages, folder, least)
        back = warc.parse_records(warc.read_records(spark, folder))
        got = back.select("page_id", F.octet_length("payload").cast("long"), "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got)) == brute_force(ROWS, least)
        for r in back.collect():
            assert bytes(r.block) == (b"" if r.record_type == "revisit" else bytes(r.payload))
    assert spark.read.parquet(f"{tmp_path}/0/payloads").count() == len({h or "" for _, _, h in ROWS})


def test_files(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    records = warc.read_records(spark, f"{tmp_path}/a")
    warc.write_warc_files(records.coalesce(1), f"{tmp_path}/files", "none")
    said = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{tmp_path}/files/part-*").collect())
    assert said == b"".join(bytes(r.record) for r in records.coalesce(1).collect())


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/e")
    assert warc.read_records(spark, f"{tmp_path}/e").count() == 0


def test_equal_rows_have_one_response(spark, tmp_path):
    rows = [(5, "http://a", "same")] * 3 + [(5, "http://b", "same"), (4, "http://c", "same"), (5, "http://b", "same")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/d")
    back = warc.parse_records(warc.read_records(spark, f"{tmp_path}/d")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in back) == [(4, "revisit", 5), *[(5, "response", None)], *[(5, "revisit", 5)] * 4]
    assert len({bytes(r.record) for r in back}) == 6 and all(b"WARC-Date: " in bytes(r.record) for r in back)
