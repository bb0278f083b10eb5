"""Copies of the driver's tables written in other formats and read back, and slices of stored matrices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spectrafold.operators import scores as sc
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import shared_folder, table
from spectrafold.sources import readers as r
from spectrafold.sources import sparse as sp

c = F.col


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/storage-{uuid.uuid4().hex}"


@register("read_separated", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_separated(spark, d):
    """Text with tabs, whose separator and types are found in it."""
    where = f"{_folder(spark)}/customer.tsv"
    table(spark, d, "customer").write.csv(where, header=True, sep="\t")
    return r.read_table(spark, where).select(c("c_custkey").cast("long").alias("c_custkey"), "c_name", c("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


@register("read_records", "SELECT event_id, event_type, user_id, value FROM events")
def read_records(spark, d):
    where = f"{_folder(spark)}/events.jsonl"
    table(spark, d, "events").write.json(where)
    return r.read_table(spark, where, ["event_id", "event_type", "user_id", "value"])


@register("read_by_content", "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT p_partkey, p_brand FROM part")
def read_by_content(spark, d):
    """Folders without a suffix are told by their files' first bytes."""
    folder = _folder(spark)
    table(spark, d, "orders").write.parquet(f"{folder}/a")
    table(spark, d, "part").write.orc(f"{folder}/b")
    one = r.read_table(spark, f"{folder}/a", ["o_orderkey", "o_orderstatus"])
    return one.union(r.read_table(spark, f"{folder}/b", ["p_partkey", "p_brand"]))


@register("upserted", """WITH n AS (SELECT c_custkey, c_acctbal*2 c_acctbal, c_custkey%3 v FROM customer WHERE c_custkey%2=0 UNION ALL SELECT c_custkey+10000000, c_acctbal, 1 FROM customer WHERE c_custkey%5=0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, round(CASE WHEN n.v>=1 OR o.c_custkey IS NULL THEN n.c_acctbal ELSE o.c_acctbal END,2) AS c_acctbal, CASE WHEN n.v>=1 OR o.c_custkey IS NULL THEN n.v ELSE 1 END::INT AS version FROM customer o FULL JOIN n ON n.c_custkey=o.c_custkey""")
def upserted(spark, d):
    """Later versions win, and of equal ones the change."""
    now = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("version"))
    changed = now.where("c_custkey % 2 = 0").select("c_custkey", (c("c_acctbal") * 2).alias("c_acctbal"), (c("c_custkey") % 3).cast("int").alias("version"))
    new = now.where("c_custkey % 5 = 0").select((c("c_custkey") + 10000000).alias("c_custkey"), "c_acctbal", "version")
    return rounded(r.upsert(now, changed.unionByName(new), ["c_custkey"], "version"), 2)


@register("entries_read_back", "SELECT 'part' || p_partkey AS key, 'article' AS kind, p_name AS title, '{' || p_brand || '}, ' || p_type AS journal, p_size::VARCHAR AS year FROM part")
def entries_read_back(spark, d):
    """Entries with nested braces, rendered from parts, written as text and parsed again."""
    where = f"{_folder(spark)}/parts.bib"
    journal = F.concat(F.lit("{"), c("p_brand"), F.lit("}, "), c("p_type"))
    entry = sc.bibtex(F.lit("article"), F.concat(F.lit("part"), c("p_partkey").cast("string")), {"title": c("p_name"), "journal": journal, "year": c("p_size")})
    table(spark, d, "part").select(entry.alias("value")).write.text(where)
    f = c("fields")
    return r.bibtex(spark, where).select("key", "kind", f["title"].alias("title"), f["journal"].alias("journal"), f["year"].alias("year"))


def _stored(spark, d):
    folder = _folder(spark)
    sold = table(spark, d, "lineitem").select(c("l_suppkey").alias("row"), c("l_partkey").alias("column"), c("l_quantity").alias("value"))
    sp.write_matrix(sold, folder, 16, 256)
    return folder


@register("matrix_slice", """WITH a AS (SELECT DISTINCT l_suppkey s FROM lineitem), b AS (SELECT DISTINCT l_partkey p FROM lineitem), r AS (SELECT s, row_number() OVER (ORDER BY s)-1 i FROM a), k AS (SELECT p, row_number() OVER (ORDER BY p)-1 j FROM b)
SELECT l_suppkey AS row, l_partkey AS "column", sum(l_quantity) AS value FROM lineitem JOIN r ON s=l_suppkey JOIN k ON p=l_partkey WHERE i>=10 AND i<40 AND j>=100 AND j<700 GROUP BY 1,2""")
def matrix_slice(spark, d):
    """Suppliers 10 to 39 and parts 100 to 699 of what was sold."""
    return sp.read_slice(spark, _stored(spark, d), range(10, 40), range(100, 700))


@register("column_variance", """WITH m AS (SELECT l_suppkey s, l_partkey p, sum(l_quantity) x FROM lineitem GROUP BY 1,2), n AS (SELECT count(DISTINCT l_suppkey)::DOUBLE n FROM lineitem)
SELECT p AS "column", round(sum(x)/any_value(n),6) AS mean, round(sum(x*x)/any_value(n)-pow(sum(x)/any_value(n),2),6) AS variance FROM m, n GROUP BY 1""")
def column_variance(spark, d):
    """Over all rows, as there are not more of them than asked for."""
    return rounded(sp.sampled_variance(spark, _stored(spark, d), 10**9), 6)
