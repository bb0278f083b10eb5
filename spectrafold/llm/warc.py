"""Content-addressed web archive.

Payload bytes are stored once, under a strong digest (SHA-256) verified by
length and a second digest on writing and by recomputation on reading.  Record
headers are kept separately and exactly, with the digest of their payload, so
original records come back through a join.  Of the records with one payload
(of at least ``min_bytes``) that with the largest page id is the response, the
others are revisits of it; records with smaller payloads are all responses.

``write_archive`` writes two Parquet tables in the folder given; ``read_records``
joins them and gives the bytes of every original WARC record; ``parse_records``
takes such bytes apart again.  ``write_warc_files`` writes plain ``.warc`` files.

Only digests, sizes and ids are shuffled to find the responses; payloads
travel once to be stored and once to be joined back.  A payload shared by very
many records joins on its digest with one stored row, which Spark's skew join
can split.

Defined results: a null html is an empty payload; ids may repeat (of the rows of
the largest id that of the last url is the response, and one of equal rows); null urls
give an empty target; empty tables give empty archives; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._store import Scratch

CRLF = "\r\n"
#: RFC 4648 base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexes: Column) -> Column:
    """Base 32 of a SHA-1 given in hex: eight groups of five hex digits, four letters each."""

    def letters(i: Column) -> Column:
        group = F.conv(F.substring(hexes, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def _records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each row's payload with its digests and exact header."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "key": F.sha2("payload", 256), "payload_digest": base32(F.sha1("payload"))})


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``payloads`` and ``headers`` under ``folder``."""
    rows = _records(pages, id_col, url_col, html_col)
    # Rows equal in all of these are told apart by a copy number; the first of them may be the response.
    marks = rows.groupBy("page_id", "url", "payload_bytes", "key", "payload_digest").agg(F.count("*").cast("int").alias("times"))
    large = F.col("payload_bytes") >= min_bytes
    first = marks.where(large).groupBy("key").agg(
        F.max(F.struct(F.col("page_id"), F.col("url"))).alias("last"),
        # Equal strong digests must mean equal payloads: length and second digest may not differ.
        F.min("payload_bytes").alias("least"),
        F.max("payload_bytes").alias("most"),
        F.min("payload_digest").alias("one"),
        F.max("payload_digest").alias("two"),
    )
    sound = (F.col("least") == F.col("most")) & (F.col("one") == F.col("two"))
    first = first.select("key", F.when(sound, F.col("last")).otherwise(F.raise_error(F.lit("different payloads under one digest"))).alias("last"))
    joined = marks.join(first, "key", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    revisit = large & ~((F.col("copy") == 1) & F.col("page_id").eqNullSafe(F.col("last.page_id")) & (F.col("url") == F.col("last.url")))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        kind,
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.when(F.col("copy") > 1, F.concat(F.lit(":"), F.col("copy").cast("string"))).otherwise(F.lit("")),
        F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        F.regexp_replace("url", "[\r\n]", "%0A"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:"), F.coalesce(F.col("last.page_id").cast("string"), F.lit("")), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")),
        F.lit(CRLF + CRLF),
    )
    joined.select("page_id", head.cast("binary").alias("header"), "key", "payload_bytes").write.mode("overwrite").parquet(f"{folder}/headers")
    # One copy of each payload: rows of a hot payload are cut to one per task before they meet.
    stored = rows.select("key", "payload_bytes", "payload").groupBy("key").agg(F.first("payload").alias("payload"))
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers taken apart: page_id, record_type, payload_digest, refers_to, target, length, key, payload_bytes."""
    heads = spark.read.parquet(f"{folder}/headers")
    return heads.select("page_id", "key", "payload_bytes", *_fields(F.col("header").cast("string")))


def _fields(head: Column) -> list[Column]:
    value = lambda name: F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    refers = F.regexp_extract(value("WARC-Refers-To"), r"<urn:page:(-?[0-9]+)>", 1)
    return [
        value("WARC-Type").alias("record_type"),
        F.regexp_extract(value("WARC-Payload-Digest"), r"^sha1:(.*)$", 1).alias("payload_digest"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        value("WARC-Target-URI").alias("target"),
        value("Content-Length").cast("long").alias("content_length"),
    ]


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Original records as bytes: ``page_id``, ``record`` (header, payload where the record holds it, closing lines) and the full ``payload``."""
    payloads = spark.read.parquet(f"{folder}/payloads")
    payloads = payloads.select("key", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary")).alias("payload"))
    heads = spark.read.parquet(f"{folder}/headers")
    full = heads.join(payloads, "key")
    own = ~F.col("header").cast("string").contains(f"WARC-Type: revisit{CRLF}")
    record = F.concat("header", F.when(own, F.col("payload")).otherwise(F.lit(b"")), F.lit((CRLF + CRLF).encode()))
    return full.select("page_id", record.alias("record"), "payload")


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of each record from its bytes, with its ``block`` (null where lengths don't fit)."""
    head = F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 1)
    parsed = records.withColumn("head", F.concat(head, F.lit(CRLF)))
    at = F.octet_length("head") + 2
    parsed = parsed.select("*", *_fields(F.col("head"))).withColumn("at", at)
    fits = F.octet_length("record") == F.col("at") + F.col("content_length") + 4
    block = F.when(fits, F.expr("substring(record, at + 1, CAST(content_length AS INT))"))
    return parsed.withColumn("block", block).drop("head", "at")


def write_warc_files(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Plain WARC files: the writer's line ends are the lines that close a record."""
    body = F.expr(f"substring(record, 1, octet_length(record) - {len(CRLF) * 2})").cast("string")
    records.select(body.alias("value")).write.mode("overwrite").option("lineSep", CRLF + CRLF).option("compression", compression).text(folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the records back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = parse_records(read_records(spark, folder))
    checked = F.when((F.col("record_type") == "revisit") | (F.col("block") == F.col("payload")), F.col("record_type")).otherwise(F.raise_error(F.lit("a record does not read back")))
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), checked.alias("record_type"), "refers_to", "target")

