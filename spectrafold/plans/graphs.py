"""Betweenness and graphs of what varies together, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators import coexpression as x
from spectrafold.operators import graphs as g
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table

c = F.col


def _moves(spark, d):
    """From the ``k`` of an event to that of its user's next one, where the step occurs for at least two users in a quarter of the day."""
    k = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(60))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events").select("user_id", k.alias("src"), F.lead(k).over(w).alias("dst"), (F.hour("ts") / 6).cast("int").alias("q")).where("dst IS NOT NULL AND src <> dst")
    return steps.groupBy("src", "dst", "q").agg(F.count_distinct("user_id").alias("n")).where("n >= 2").select("src", "dst").distinct()


@register("betweenness", """WITH RECURSIVE t AS (SELECT user_id, ((props->>'k')::INT)%60 src, lead(((props->>'k')::INT)%60) OVER (PARTITION BY user_id ORDER BY ts, event_id) dst, hour(ts)//6 q FROM events),
 e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst, q FROM t WHERE dst IS NOT NULL AND src<>dst GROUP BY 1,2,3 HAVING count(DISTINCT user_id)>=2)), n AS (SELECT src v FROM e UNION SELECT dst FROM e),
 r AS (SELECT v s, v, 0 d FROM n UNION SELECT r.s, e.dst, r.d+1 FROM r JOIN e ON e.src=r.v WHERE r.d<12), h AS (SELECT s, v, min(d) d FROM r GROUP BY 1,2),
 p AS (SELECT v s, v, 0 d, 1.0::DOUBLE n FROM n UNION ALL SELECT p.s, h.v, h.d, sum(p.n) FROM p JOIN e ON e.src=p.v JOIN h ON h.s=p.s AND h.v=e.dst AND h.d=p.d+1 GROUP BY 1,2,3),
 b AS (SELECT a.v, sum(a.n*z.n/w.n) b FROM p a JOIN p z ON z.s=a.v JOIN p w ON w.s=a.s AND w.v=z.v AND w.d=a.d+z.d WHERE a.s<>a.v AND z.v<>a.v AND a.s<>z.v GROUP BY 1)
SELECT n.v AS node, round(coalesce(b,0)/((SELECT count(*) FROM n)-1)/((SELECT count(*) FROM n)-2),8) AS betweenness FROM n LEFT JOIN b ON b.v=n.v""")
def betweenness(spark, d):
    return rounded(g.betweenness(_moves(spark, d)), 8)


def _sold(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    return line.select(c("l_suppkey").alias("sample"), c("p_brand").alias("gene"), c("l_quantity").alias("value"))


_RESIDUAL = """s AS (SELECT s_suppkey s, s_acctbal x FROM supplier), y AS (SELECT l_suppkey s, p_brand g, sum(l_quantity) y FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2),
 f AS (SELECT s.s, x, b.g, coalesce(y,0) y FROM s CROSS JOIN (SELECT DISTINCT g FROM y) b LEFT JOIN y ON y.s=s.s AND y.g=b.g),
 m AS (SELECT a.g a, b.g b, covar_pop(a.y,b.y)-covar_pop(a.y,a.x)*covar_pop(b.y,b.x)/var_pop(a.x) c FROM f a JOIN f b ON a.s=b.s GROUP BY 1,2),
 r AS (SELECT m.a, m.b, abs(m.c)/sqrt(u.c*v.c) w FROM m JOIN m u ON u.a=m.a AND u.b=m.a JOIN m v ON v.a=m.b AND v.b=m.b),
 e AS (SELECT a AS src, b AS dst, w AS weight, row_number() OVER (PARTITION BY b ORDER BY w DESC, a) k FROM r WHERE a<>b), o AS (SELECT src, dst, weight FROM e WHERE k<=3 AND weight>0.05 UNION ALL SELECT a, a, 1.0::DOUBLE FROM r WHERE a=b)"""


@register("residual_graph", f"WITH {_RESIDUAL} SELECT src, dst, round(weight,6) AS weight FROM o")
def residual_graph(spark, d):
    """Brands that a supplier sells together beyond what the supplier's balance explains."""
    design = table(spark, d, "supplier").select(c("s_suppkey").alias("sample"), F.array("s_acctbal").alias("design"))
    return rounded(x.residual_graph(_sold(spark, d), design, 3, 0.05), 6)


@register("graph_overlap", f"""WITH {_RESIDUAL}, z AS (SELECT DISTINCT least(src,dst) a, greatest(src,dst) b FROM o WHERE src<>dst),
 t AS (SELECT DISTINCT CASE WHEN p.p_brand<q.p_brand THEN p.p_brand ELSE q.p_brand END a, CASE WHEN p.p_brand<q.p_brand THEN q.p_brand ELSE p.p_brand END b FROM part p JOIN part q ON q.p_partkey=p.p_partkey+1 AND p.p_size=q.p_size AND p.p_brand<>q.p_brand)
SELECT (SELECT count(*) FROM z) AS edges_first, (SELECT count(*) FROM t) AS edges_second, count(*) AS shared, round(count(*)/((SELECT count(*) FROM z)+(SELECT count(*) FROM t)-count(*)),6) AS jaccard, round(count(*)/(SELECT count(*) FROM z),6) AS of_first, round(count(*)/(SELECT count(*) FROM t),6) AS of_second FROM z JOIN t USING(a,b)""")
def graph_overlap(spark, d):
    """Edges shared with brands of neighbouring parts of one size; as in SQL, a share of no edges is no number."""
    design = table(spark, d, "supplier").select(c("s_suppkey").alias("sample"), F.array("s_acctbal").alias("design"))
    p = table(spark, d, "part").select("p_partkey", "p_size", c("p_brand").alias("src"))
    q = table(spark, d, "part").select((c("p_partkey") - 1).alias("p_partkey"), "p_size", c("p_brand").alias("dst"))
    return rounded(x.edge_overlap(x.residual_graph(_sold(spark, d), design, 3, 0.05), p.join(q, ["p_partkey", "p_size"]), float("nan")), 6)
