"""Greedy deduplication in an order over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import selection as s
from spectrafold.registry import register
from spectrafold.session import table


@register("multi_key_dedup", """WITH RECURSIVE k AS (SELECT row_number() OVER (ORDER BY c_custkey) i, c_custkey, 'a' || c_nationkey || c_mktsegment || floor(c_acctbal/1000)::BIGINT x, 'b' || floor(c_acctbal/10)::BIGINT y, 'c' || right(c_name, 3) z FROM customer),
 s AS (SELECT 0::BIGINT i, NULL::BIGINT c_custkey, []::VARCHAR[] seen, []::BIGINT[] ids, false AS kept, NULL::VARCHAR matched_on, NULL::BIGINT AS matched UNION ALL
 SELECT k.i, k.c_custkey, CASE WHEN list_has_any(seen, [x,y,z]) THEN seen ELSE list_concat(seen, [x,y,z]) END, CASE WHEN list_has_any(seen, [x,y,z]) THEN ids ELSE list_append(ids, k.c_custkey) END, NOT list_has_any(seen, [x,y,z]),
  CASE WHEN list_contains(seen, x) THEN 'group' WHEN list_contains(seen, y) THEN 'balance' WHEN list_contains(seen, z) THEN 'tail' END,
  ids[(coalesce(nullif(list_position(seen, x), 0), nullif(list_position(seen, y), 0), nullif(list_position(seen, z), 0)) - 1)//3 + 1] FROM s JOIN k ON k.i = s.i+1)
SELECT c_custkey, kept, matched_on, coalesce(matched, c_custkey) AS stands_for FROM s WHERE i > 0""")
def multi_key_dedup(spark, d):
    customers = table(spark, d, "customer")
    keys = {
        "group": F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("string")),
        "balance": F.floor(F.col("c_acctbal") / 10),
        "tail": F.expr("right(c_name, 3)"),
    }
    return s.multi_key_dedup(customers, "c_custkey", keys).select("c_custkey", "kept", "matched_on", F.coalesce("matched", "c_custkey").alias("stands_for"))


@register("fuzzy_title_dedup")
def fuzzy_title_dedup(spark, d):
    """Pages by address and then by a title like that of a kept page; SQL lacks the ratio, tests/test_selection.py goes through the pages one by one."""
    pages = table(spark, d, "pages")
    keys = {"address": F.regexp_extract("url", "^[^?]+", 0)}
    return s.multi_key_dedup(pages, "page_id", keys, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).select("page_id", "kept", "matched_on", F.coalesce("matched", "page_id").alias("stands_for"))


@register("redundancy_filter", r"""WITH RECURSIVE k AS (SELECT row_number() OVER (ORDER BY page_id) i, page_id, list_distinct(regexp_split_to_array(lower(trim(t)), '\s+')) w FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) t FROM pages) WHERE trim(t) <> ''),
 s AS (SELECT 0::BIGINT i, NULL::BIGINT page_id, []::VARCHAR[][] seen, []::BIGINT[] ids, NULL::BIGINT AS matched UNION ALL
 SELECT k.i, k.page_id, CASE WHEN len(f) > 0 THEN seen ELSE list_append(seen, w) END, CASE WHEN len(f) > 0 THEN ids ELSE list_append(ids, k.page_id) END, f[1] FROM
 (SELECT k.i, k.page_id, w, seen, ids, list_filter(ids, lambda x, j: len(list_intersect(seen[j], w)) >= 0.5*len(list_distinct(list_concat(seen[j], w))) - 1e-9) f FROM s JOIN k ON k.i = s.i+1) k)
SELECT page_id, matched IS NULL AS kept, coalesce(matched, page_id) AS stands_for FROM s WHERE i > 0 UNION ALL SELECT page_id, true, page_id FROM pages WHERE trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) = ''""")
def redundancy_filter(spark, d):
    return s.redundancy_filter(table(spark, d, "pages"), "page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), 0.5).select("page_id", "kept", F.coalesce("matched", "page_id").alias("stands_for"))
