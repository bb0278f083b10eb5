"""Graph steps, merging, rankings, related rows and event rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import networks as n
from spectrafold.registry import register
from spectrafold.session import table

c = F.col
_E = "SELECT DISTINCT o_custkey src, 100000+l_suppkey dst FROM orders JOIN lineitem ON o_orderkey=l_orderkey"


def _edges(spark, d):
    sold = table(spark, d, "orders").join(table(spark, d, "lineitem"), c("o_orderkey") == c("l_orderkey"))
    return sold.select(c("o_custkey").alias("src"), (c("l_suppkey") + 100000).alias("dst")).distinct()


@register("one_hop", f"SELECT dst AS node, s_name, s_acctbal FROM ({_E}) JOIN supplier ON dst=100000+s_suppkey WHERE src=1 AND s_acctbal>0 ORDER BY s_acctbal DESC, dst LIMIT 20")
def one_hop(spark, d):
    nodes = table(spark, d, "supplier").select((c("s_suppkey") + 100000).alias("id"), "s_name", "s_acctbal").where("s_acctbal > 0")
    start = table(spark, d, "customer").where("c_custkey = 1").select(c("c_custkey").alias("node"))
    return n.one_hop(_edges(spark, d), start, nodes, [F.desc("s_acctbal"), c("dst")], 20).select(c("dst").alias("node"), "s_name", "s_acctbal")


@register("hops_any_way", f"""WITH e AS ({_E}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst n FROM u WHERE src=1), h2 AS (SELECT DISTINCT u.dst n FROM h1 JOIN u ON u.src=h1.n WHERE u.dst<>1 AND u.dst NOT IN (SELECT n FROM h1))
SELECT 1::BIGINT AS root, n AS node, 1 AS distance FROM h1 UNION ALL SELECT 1, n, 2 FROM h2""")
def hops_any_way(spark, d):
    return n.hops_any_way(_edges(spark, d), table(spark, d, "customer").where("c_custkey = 1").select(c("c_custkey").alias("node")), 2)


@register("shortest_paths", f"""WITH e AS ({_E}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), a AS (SELECT dst x FROM u WHERE src=1), b AS (SELECT u.dst y, min(a.x) x FROM a JOIN u ON u.src=a.x WHERE u.dst<>1 GROUP BY 1)
SELECT 1::BIGINT AS root, y AS node, 2 AS distance, '1-' || x::VARCHAR || '-' || y::VARCHAR AS path FROM b WHERE y BETWEEN 2 AND 200""")
def shortest_paths(spark, d):
    start = table(spark, d, "customer").where("c_custkey = 1").select(c("c_custkey").alias("node"))
    goal = table(spark, d, "customer").where("c_custkey BETWEEN 2 AND 200").select(c("c_custkey").alias("goal"))
    out = n.shortest_paths(n.undirected(_edges(spark, d)), start, goal, 2)
    return out.select("root", "node", "distance", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


_TREE = "SELECT p_partkey node, CASE WHEN p_partkey>1 THEN p_partkey//10 END parent FROM part"


@register("tree_closure", f"""WITH RECURSIVE t AS ({_TREE}), r AS (SELECT parent a, node n, 1 k FROM t WHERE parent>0 UNION ALL SELECT r.a, t.node, k+1 FROM r JOIN t ON t.parent=r.n WHERE k<3) SELECT a AS ancestor, n AS node, k::INT AS distance FROM r""")
def tree_closure(spark, d):
    tree = table(spark, d, "part").select(c("p_partkey").alias("node"), F.when(c("p_partkey") >= 10, F.floor(c("p_partkey") / 10)).alias("parent"))
    return n.closure(tree, 3)


@register("clusters", """WITH RECURSIVE e AS (SELECT p_partkey a, p_partkey+3 b FROM part WHERE p_partkey%7<>0 AND p_partkey+3 <= (SELECT max(p_partkey) FROM part)), r AS (SELECT p_partkey id, p_partkey root FROM part WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.b=p_partkey) UNION ALL SELECT e.b, r.root FROM r JOIN e ON e.a=r.id)
SELECT id, root AS cluster FROM r""")
def clusters(spark, d):
    part = table(spark, d, "part").select(c("p_partkey").alias("id"))
    edges = part.where("id % 7 <> 0").select(c("id").alias("src"), (c("id") + 3).alias("dst"))
    return n.clusters(edges.join(part, edges.dst == part.id, "left_semi"), part)


@register("valid_edges", "SELECT l_orderkey AS src, l_suppkey AS dst, l_returnflag AS kind, l_tax*20 AS confidence FROM lineitem WHERE l_orderkey<>l_suppkey AND l_returnflag IN ('A','N') AND l_tax*20 BETWEEN 0 AND 1")
def valid_edges(spark, d):
    return n.valid_edges(table(spark, d, "lineitem").select(c("l_orderkey").alias("src"), c("l_suppkey").alias("dst"), c("l_returnflag").alias("kind"), (c("l_tax") * 20).alias("confidence")), ["A", "N"])


@register("node_upsert", "SELECT s_suppkey AS id, s_acctbal AS v FROM supplier WHERE s_suppkey%3<>0 UNION ALL SELECT s_suppkey, s_acctbal+1 FROM supplier WHERE s_suppkey%3=0 UNION ALL SELECT 100000+s_suppkey, 0.0 FROM supplier WHERE s_suppkey%5=0")
def node_upsert(spark, d):
    s = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_acctbal").alias("v"))
    new = s.where("id % 3 = 0").select("id", c("v") + 1).union(s.where("id % 5 = 0").select(c("id") + 100000, F.lit(0.0))).toDF("id", "v")
    return n.merged(s, new.union(new.where("v = 0")), ["id"])


@register("edge_upsert", f"SELECT src, dst, max(w) AS weight FROM (SELECT src, dst, CASE WHEN (src+dst)%2=0 THEN 2 ELSE 1 END w FROM ({_E})) GROUP BY 1,2")
def edge_upsert(spark, d):
    e = _edges(spark, d)
    return n.merged(e.withColumn("weight", F.lit(1)), e.where("(src + dst) % 2 = 0").withColumn("weight", F.lit(2)), ["src", "dst"])


@register("detach_delete", f"SELECT src, dst FROM ({_E}) WHERE src%4<>0 AND dst%4<>0")
def detach_delete(spark, d):
    e = _edges(spark, d)
    nodes = e.select(c("src").alias("id")).union(e.select("dst")).distinct()
    return n.without_nodes(nodes, e, nodes.where("id % 4 = 0"))[1]


@register("appended_notes", "SELECT c_custkey, concat_ws(',', c_mktsegment, string_agg(o_orderstatus || o_orderkey::VARCHAR, ',' ORDER BY o_orderstatus || o_orderkey::VARCHAR)) AS notes FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey, c_mktsegment")
def appended_notes(spark, d):
    notes = table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), F.concat("o_orderstatus", c("o_orderkey").cast("string")).alias("note"))
    out = n.appended(table(spark, d, "customer").select("c_custkey", F.array("c_mktsegment").alias("notes")), "c_custkey", notes, "note", "notes")
    return out.withColumn("notes", F.array_join("notes", ","))


_W = "SELECT l_suppkey src, l_suppkey%17+l_linenumber dst, count(*) weight FROM lineitem GROUP BY 1,2"


@register("symmetric_top", f"""WITH w AS ({_W}), t AS (SELECT src, dst FROM w WHERE weight>=2 AND src<>dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)<=2)
SELECT src, dst FROM t UNION SELECT dst, src FROM t UNION SELECT src, src FROM w UNION SELECT dst, dst FROM w""")
def symmetric_top(spark, d):
    w = table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("src"), (c("l_suppkey") % 17 + c("l_linenumber")).alias("dst")).agg(F.count("*").alias("weight"))
    return n.symmetric_top(w, 2, 2)


@register("edge_overlap", """WITH a AS (SELECT DISTINCT least(l_suppkey,l_linenumber) a, greatest(l_suppkey,l_linenumber) b FROM lineitem WHERE l_suppkey<>l_linenumber AND l_returnflag='A'), b AS (SELECT DISTINCT least(l_suppkey,l_linenumber) a, greatest(l_suppkey,l_linenumber) b FROM lineitem WHERE l_suppkey<>l_linenumber AND l_quantity>10),
 m AS (SELECT (SELECT count(*) FROM a) x, (SELECT count(*) FROM b) y, (SELECT count(*) FROM a JOIN b USING(a,b)) s) SELECT x AS n_first, y AS n_second, s AS shared, s/(x+y-s) AS jaccard, s/least(x,y) AS containment FROM m""")
def edge_overlap(spark, d):
    li = table(spark, d, "lineitem").select(c("l_suppkey").alias("src"), c("l_linenumber").cast("long").alias("dst"), "l_returnflag", "l_quantity")
    return n.edge_overlap(li.where("l_returnflag = 'A'").select("src", "dst"), li.where("l_quantity > 10").select("dst", "src").toDF("src", "dst"))


@register("conflicts", """WITH f AS (SELECT event_id, user_id, value-50 e, (event_id%10)/100.0::DOUBLE p FROM events), l AS (SELECT *, lag(e) OVER w e0, lag(p) OVER w p0 FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN e0 IS NULL THEN 'first' WHEN sign(e0)*sign(e)<0 THEN 'sign' WHEN (p0<0.05)<>(p<0.05) THEN 'significance' ELSE 'accord' END AS conflict FROM l""")
def conflicts(spark, d):
    f = table(spark, d, "events").select("event_id", "user_id", (c("value") - 50).alias("e"), (c("event_id") % 10 / F.lit(100.0)).alias("p"))
    return n.conflicts(f, "user_id", "event_id", "e", "p").select("event_id", "conflict")


@register("mapped_join", """WITH l AS (SELECT CASE WHEN c_custkey%2=0 THEN c_custkey+1 ELSE c_custkey END id, c_acctbal f FROM customer), r AS (SELECT s_suppkey id, s_acctbal s FROM supplier)
SELECT id, f AS first, s AS second, sign(f)=sign(s) AS concordant FROM l JOIN r USING(id)""")
def mapped_join(spark, d):
    left = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_acctbal").alias("change"))
    mapping = left.where("id % 2 = 0").select("id", (c("id") + 1).alias("other"))
    return n.mapped_join(left, mapping, table(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_acctbal").alias("change")))


@register("both_ways", "SELECT n_nationkey AS a, n_regionkey+100 AS b, (n_nationkey%10)/10.0::DOUBLE AS confidence FROM nation WHERE n_nationkey%10>=5 UNION ALL SELECT n_regionkey+100, n_nationkey, (n_nationkey%10)/10.0::DOUBLE FROM nation WHERE n_nationkey%10>=5")
def both_ways(spark, d):
    m = table(spark, d, "nation").select(c("n_nationkey").alias("a"), (c("n_regionkey") + 100).alias("b"), (c("n_nationkey") % 10 / F.lit(10.0)).alias("confidence"))
    return n.both_ways(m, 0.5)


@register("union_first", "SELECT o_orderkey, 'F' AS pool FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_orderkey, 'big' FROM orders WHERE o_totalprice>200000 AND o_orderstatus<>'F'")
def union_first(spark, d):
    o = table(spark, d, "orders")
    return n.union_first(o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("F").alias("pool")), o.where("o_totalprice > 200000").select("o_orderkey", F.lit("big").alias("pool")), "o_orderkey")


@register("vote_ranking", "WITH v AS (SELECT l_partkey, count(*) votes, avg(l_linenumber) r FROM lineitem GROUP BY 1) SELECT l_partkey, votes, round(r,6) AS mean_rank, row_number() OVER (ORDER BY votes DESC, r, l_partkey)::INT AS place FROM v")
def vote_ranking(spark, d):
    return n.vote_ranking(table(spark, d, "lineitem"), "l_partkey", "l_linenumber").withColumn("mean_rank", F.round("mean_rank", 6))


@register("best_strategy", "WITH t AS (SELECT event_type, avg((value>50)::INT) r FROM events GROUP BY 1), a AS (SELECT event_type FROM t UNION SELECT 'untried') SELECT event_type, round(coalesce(r,1),6)::DOUBLE AS rate FROM a LEFT JOIN t USING(event_type) ORDER BY 2 DESC, 1 LIMIT 1")
def best_strategy(spark, d):
    e = table(spark, d, "events")
    names = e.select("event_type").distinct().union(e.sparkSession.range(1).select(F.lit("untried")))
    return n.best_strategy(e, names, "event_type", c("value") > 50)


@register("merged_candidates", """WITH g AS (SELECT l_partkey k, l_returnflag p, list_sort(list(DISTINCT l_linenumber)) q, max(l_extendedprice) s FROM lineitem GROUP BY 1,2)
SELECT k AS l_partkey, p AS l_returnflag, array_to_string(q,',') AS queries, s AS score, row_number() OVER (PARTITION BY p ORDER BY s DESC, len(q) DESC, k)::INT AS place FROM g QUALIFY place<=15""")
def merged_candidates(spark, d):
    out = n.merged_candidates(table(spark, d, "lineitem"), "l_partkey", "l_linenumber", "l_returnflag", "l_extendedprice", 15)
    return out.select("l_partkey", "l_returnflag", F.array_join(F.transform("queries", lambda q: q.cast("string")), ",").alias("queries"), "score", "place")


@register("top_magnitudes", "SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey)::INT AS place FROM customer QUALIFY place<=5")
def top_magnitudes(spark, d):
    return n.top_magnitudes(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_custkey", "c_acctbal", 5)


@register("evicted", "WITH s AS (SELECT event_id, sum(user_id) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) u, sum(user_id) OVER () t FROM events) SELECT event_id FROM s WHERE t<=100000 OR u<=80000")
def evicted(spark, d):
    return n.evict(table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id", 100000).select("event_id")


@register("period_alerts", """WITH r AS (SELECT date_trunc('day',ts)::TIMESTAMP p, event_id, sum(value) OVER (PARTITION BY date_trunc('day',ts) ORDER BY event_id) s FROM events), t AS (SELECT unnest([500.0,2000.0,5000.0])::DOUBLE t)
SELECT p AS period, t AS threshold, min(event_id) AS at FROM r, t WHERE s>=t GROUP BY 1,2""")
def period_alerts(spark, d):
    return n.alerts_per_period(table(spark, d, "events"), F.date_trunc("day", "ts"), "event_id", "value", [500, 2000, 5000])


@register("trailing_activity", "WITH m AS (SELECT max(ts) m FROM events), r AS (SELECT event_type, count(*) n FROM events, m WHERE ts > m - INTERVAL 5000 MINUTE GROUP BY 1) SELECT event_type, n, n/sum(n) OVER () AS share FROM r")
def trailing_activity(spark, d):
    return n.trailing_activity(table(spark, d, "events"), "ts", 5000, "event_type")


@register("cooldown_alerts", """WITH RECURSIVE e AS (SELECT DISTINCT event_type k, ts FROM events WHERE value>80), r AS (SELECT k, min(ts) ts FROM e GROUP BY 1 UNION ALL SELECT r.k, (SELECT min(e.ts) FROM e WHERE e.k=r.k AND e.ts>=r.ts + INTERVAL 600 MINUTE) FROM r WHERE r.ts IS NOT NULL)
SELECT k AS event_type, ts FROM r WHERE ts IS NOT NULL""")
def cooldown_alerts(spark, d):
    e = table(spark, d, "events")
    return n.with_cooldown(e.withColumn("ts", c("ts").cast("timestamp")), "event_type", "ts", c("value") > 80, 600).withColumn("ts", c("ts").cast(e.schema["ts"].dataType))


@register("expired_rows", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'")
def expired_rows(spark, d):
    return n.expired(table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")), "ts", F.lit("2024-01-11 00:00:00").cast("timestamp"), 86400).select("event_id")


@register("retained_rows", "SELECT o_orderkey FROM orders WHERE o_totalprice>300000 OR o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderpriority LIKE '1%'")
def retained_rows(spark, d):
    return n.retained(table(spark, d, "orders"), c("o_totalprice") > 300000, c("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"), c("o_orderpriority").like("1%")).select("o_orderkey")


@register("text_matches", "SELECT p_partkey FROM part WHERE contains(lower(p_name),'red') OR contains(lower(p_type),'red') OR contains(lower(p_type),'promo')")
def text_matches(spark, d):
    part = table(spark, d, "part")
    return n.text_matches(part, "Red", ["p_name", "p_type"]).select("p_partkey").union(n.text_matches(part, "Promo", ["p_type"]).select("p_partkey")).distinct()


@register("name_filter", "SELECT p_partkey FROM part WHERE (contains(lower(p_name),'blue') AND contains(lower(p_name),'bolt')) OR contains(lower(p_name),'ring')")
def name_filter(spark, d):
    return n.any_name_all_words(table(spark, d, "part"), "p_name", ["blue bolt", "Ring"]).select("p_partkey")


@register("projected_columns", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def projected_columns(spark, d):
    return n.project(table(spark, d, "orders"), ["o_order"])


@register("aligned_columns", "SELECT c_custkey AS \"C-CustKey\", c_acctbal AS \"c acctbal\" FROM customer")
def aligned_columns(spark, d):
    return n.aligned(table(spark, d, "customer"), ["C-CustKey", "c acctbal", "absent"])


@register("pooled_tables", "SELECT 'c:' || c_custkey::VARCHAR AS id, c_acctbal AS balance, 'c' AS origin FROM customer UNION ALL SELECT 's:' || s_suppkey::VARCHAR, s_acctbal, 's' FROM supplier")
def pooled_tables(spark, d):
    cust = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_acctbal").alias("balance"))
    return n.pooled({"c": cust, "s": table(spark, d, "supplier").select(c("s_acctbal").alias("balance"), c("s_suppkey").alias("id"))}, "id")


@register("newest_listing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus='F' AND o_totalprice>=200000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_listing(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice >= 200000")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@register("listing_with_children", "SELECT o_orderkey, count(l_orderkey) AS n_lines, round(sum(l_extendedprice),2) AS value FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey WHERE o_orderstatus='P' GROUP BY 1")
def listing_with_children(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return o.join(table(spark, d, "lineitem"), c("l_orderkey") == c("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


@register("lookback_slice", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus='F') AS validated, round(count(*) FILTER (WHERE o_orderstatus='F')/count(*),6) AS rate FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997")
def lookback_slice(spark, d):
    o = table(spark, d, "orders").where(F.year("o_orderdate").between(1995, 1997))
    return o.agg(F.count("*").alias("n"), F.count_if(c("o_orderstatus") == "F").alias("validated"), F.round(F.count_if(c("o_orderstatus") == "F") / F.count("*"), 6).alias("rate"))
