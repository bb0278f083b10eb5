"""Profiles, conditional counts, rates and comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import rollups as ro
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table

_PART = "SELECT unnest([{{variable:'p_retailprice',v:p_retailprice}},{{variable:'p_size',v:p_size::DOUBLE}}]) x FROM part".replace("{{", "{").replace("}}", "}")


@register("variable_summary", f"SELECT x.variable AS variable, count(x.v) AS n, count(*)-count(x.v) AS n_missing, round(avg(x.v),4) AS mean, round(stddev_samp(x.v),4) AS std, min(x.v) AS min, max(x.v) AS max FROM ({_PART}) GROUP BY 1")
def variable_summary(spark, d):
    return rounded(ro.variable_summary(table(spark, d, "part"), ["p_retailprice", "p_size"]))


@register("summary_map", f"WITH s AS (SELECT x.variable v, count(x.v) n, max(x.v) m FROM ({_PART}) GROUP BY 1) SELECT string_agg(v || '=' || n::VARCHAR || '/' || round(m,2)::DECIMAL(12,2)::VARCHAR, ';' ORDER BY v) AS summary FROM s")
def summary_map(spark, d):
    told = ro.summary_map(ro.variable_summary(table(spark, d, "part"), ["p_retailprice", "p_size"]))
    text = F.transform(F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string"), F.lit("/"), F.round(e["value"]["max"], 2).cast("decimal(12,2)").cast("string")))
    return told.select(F.array_join(text, ";").alias("summary"))


_CELLS = "SELECT unnest([{c:'p_brand',v:p_brand},{c:'p_size',v:p_size::VARCHAR},{c:'p_partkey',v:p_partkey::VARCHAR},{c:'p_type',v:p_type}]) x FROM part"


@register("column_profile", f"""WITH n AS (SELECT x.c c, x.v v, count(*) n FROM ({_CELLS}) GROUP BY 1,2), s AS (SELECT c, sum(n)::BIGINT r, coalesce(sum(n) FILTER (WHERE v IS NULL),0)::BIGINT z, count(v) u, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) num, min(n) rare, arg_max(v,(n,v)) top FROM n GROUP BY 1)
SELECT c AS "column", r AS n_rows, z AS n_null, u AS n_unique, num AS "numeric", rare AS rarest, top AS most_common, z/r AS null_share,
 CASE WHEN r=z THEN 'empty' WHEN u=1 THEN 'constant' WHEN u=2 THEN 'binary' WHEN num THEN 'numeric' WHEN u<=50 THEN 'category' WHEN u=r-z THEN 'identifier' ELSE 'text' END AS kind FROM s""")
def column_profile(spark, d):
    return ro.column_profile(table(spark, d, "part"), ["p_brand", "p_size", "p_partkey", "p_type"])


@register("value_counts", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def value_counts(spark, d):
    return ro.value_counts(table(spark, d, "part"), "p_type")


@register("status_rates", """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus='F') AS n_done, count(*) FILTER (WHERE o_orderstatus='F')/count(*) AS done_rate, count(*) FILTER (WHERE o_orderstatus='P') AS n_pending,
 count(*) FILTER (WHERE o_orderstatus='P')/count(*) AS pending_rate, round(avg(o_totalprice),3) AS mean_price FROM orders GROUP BY 1""")
def status_rates(spark, d):
    status = F.col("o_orderstatus")
    return ro.rates(table(spark, d, "orders"), {"done": status == "F", "pending": status == "P"}, ["o_orderpriority"], {"price": F.col("o_totalprice")}).withColumn("mean_price", F.round("mean_price", 3))


@register("call_totals", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type='error') AS n_error, count(*) FILTER (WHERE event_type='error')/count(*) AS error_rate, count(*) FILTER (WHERE value>50) AS n_slow, count(*) FILTER (WHERE value>50)/count(*) AS slow_rate, round(avg(value),4) AS mean_latency FROM events")
def call_totals(spark, d):
    out = ro.rates(table(spark, d, "events"), {"error": F.col("event_type") == "error", "slow": F.col("value") > 50}, means={"latency": F.col("value")})
    return out.withColumn("mean_latency", F.round("mean_latency", 4))


@register("accuracy_by_type", "SELECT coalesce(event_type,'all') AS event_type, count(*) AS n, count(*) FILTER (WHERE value>=50) AS hits, count(*) FILTER (WHERE value>=50)/count(*) AS rate FROM events WHERE event_type IS NOT NULL GROUP BY ROLLUP(event_type)")
def accuracy_by_type(spark, d):
    return ro.rates_with_total(table(spark, d, "events"), "event_type", F.col("value") >= 50)


@register("sums_with_total", "SELECT coalesce(l_returnflag,'all') AS l_returnflag, count(*) AS n, round(sum(l_quantity),2) AS l_quantity, round(sum(l_extendedprice),2) AS l_extendedprice FROM lineitem GROUP BY ROLLUP(l_returnflag)")
def sums_with_total(spark, d):
    return rounded(ro.sums_with_total(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]), 2)


_CHANGE = "SELECT p_brand, p_type, round(ln(avg(l_extendedprice) FILTER (WHERE l_returnflag='R')/avg(l_extendedprice) FILTER (WHERE l_returnflag<>'R'))/ln(2),6) change, (count(*)%20)/100.0::DOUBLE p FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2"


def _changes(spark, d):
    sold = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r, other = (F.avg(F.when(c, F.col("l_extendedprice"))) for c in (F.col("l_returnflag") == "R", F.col("l_returnflag") != "R"))
    return sold.groupBy("p_brand", "p_type").agg(F.round(F.log2(r / other), 6).alias("change"), ((F.count("*") % 20) / F.lit(100.0)).alias("p"))


@register("change_summary", f"WITH c AS ({_CHANGE}) SELECT p_brand, count(*) AS n, round(avg(change),4) AS mean_change, count(*) FILTER (WHERE change>0) AS n_up, count(*) FILTER (WHERE change<0) AS n_down, count(*) FILTER (WHERE p<0.05) AS n_significant, CASE WHEN avg(change)>0.02 THEN 'up' WHEN avg(change)<-0.02 THEN 'down' ELSE 'unchanged' END AS direction FROM c GROUP BY 1")
def change_summary(spark, d):
    return rounded(ro.change_summary(_changes(spark, d), ["p_brand"], "change", "p", 0.02))


@register("change_totals", f"WITH c AS ({_CHANGE}) SELECT count(p) AS tested, count(*) FILTER (WHERE p<0.05) AS significant, count(*) FILTER (WHERE p<0.05 AND change>0) AS up, count(*) FILTER (WHERE p<0.05 AND change<0) AS down, round(100.0*count(*) FILTER (WHERE p<0.05)/count(p),4) AS percent FROM c")
def change_totals(spark, d):
    return rounded(ro.change_totals(_changes(spark, d), "change", "p"))


@register("across_groups", "WITH g AS (SELECT c_mktsegment, avg(o_totalprice) v FROM customer JOIN orders ON c_custkey=o_custkey GROUP BY 1) SELECT count(v) AS n_groups, round(avg(v),3) AS mean, round(stddev_pop(v),3) AS std, round(stddev_pop(v)/abs(avg(v)),6) AS cv, stddev_pop(v)/abs(avg(v)) < 0.2 AS universal FROM g")
def across_groups(spark, d):
    groups = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.avg("o_totalprice").alias("v"))
    out = ro.across_groups(groups, "v")
    return out.select("n_groups", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), F.round("cv", 6).alias("cv"), "universal")


_FINDINGS = "SELECT l_partkey % 50 AS cluster, l_suppkey % 5 AS run, l_discount-0.05 AS effect, l_tax AS p, l_extendedprice AS score, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS summary FROM lineitem"


def _findings(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_partkey") % 50).alias("cluster"), (F.col("l_suppkey") % 5).alias("run"), (F.col("l_discount") - 0.05).alias("effect"), F.col("l_tax").alias("p"), F.col("l_extendedprice").alias("score"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("text"))


@register("replication", f"""WITH f AS ({_FINDINGS}) SELECT cluster, count(*) AS n, count(DISTINCT run)/5.0::DOUBLE AS replication_rate, round(avg(effect),5) AS effect_mean, round(stddev_pop(effect),5) AS effect_std, round(stddev_pop(effect)/abs(avg(effect)),5) AS effect_cv, avg((p<0.05)::INT)>0.5 AS mostly_significant,
 round(greatest(count(*) FILTER (WHERE effect>0),count(*) FILTER (WHERE effect<0))/count(effect),5) AS direction_agreement, arg_max(summary,(score,summary)) AS summary, CASE WHEN count(DISTINCT run)/5.0>=0.8 THEN 'strong' WHEN count(DISTINCT run)/5.0>=0.6 THEN 'moderate' WHEN count(DISTINCT run)/5.0>=0.4 THEN 'weak' ELSE 'none' END AS strength FROM f GROUP BY 1""")
def replication(spark, d):
    return rounded(ro.replication(_findings(spark, d), "cluster", "run", "effect", "p", "score", "text", 5), 5)


@register("replication_counts", "WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey%5) n FROM lineitem GROUP BY 1) SELECT count(*) AS n_clusters, count(*) FILTER (WHERE n=1) AS once, count(*) FILTER (WHERE n BETWEEN 2 AND 3) AS few, count(*) FILTER (WHERE n>=4) AS many, round(avg(n) FILTER (WHERE n>1),5) AS mean_runs_repeated FROM c")
def replication_counts(spark, d):
    """Findings of one order are a cluster, the supplier's remainder is the run."""
    return rounded(ro.replication_counts(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(F.col("l_suppkey") % 5).alias("n_runs"))), 5)


@register("conditional_rollup", "SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n, min(l_tax) AS min_p, count(*) FILTER (WHERE l_tax<0.05) AS n_significant, round(sum(l_quantity),2) AS total_l_quantity FROM lineitem GROUP BY 1")
def conditional_rollup(spark, d):
    return rounded(ro.conditional_rollup(table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate").cast("string")), ["day"], "l_tax", ["l_quantity"]), 2)


@register("complement_sums", "WITH s AS (SELECT c_nationkey, sum(c_acctbal) o FROM customer GROUP BY 1), t AS (SELECT sum(o) a FROM s) SELECT c_nationkey, round(o,2) AS own, round(a-o,2) AS others, round((a-o)/o,4) AS ratio, a-o >= 100000 AS enough FROM s, t")
def complement_sums(spark, d):
    out = ro.complement_sums(table(spark, d, "customer"), "c_nationkey", "c_acctbal", 100000)
    return out.select("c_nationkey", F.round("own", 2).alias("own"), F.round("others", 2).alias("others"), F.round("ratio", 4).alias("ratio"), "enough")


@register("collapse", "SELECT s_nationkey AS nation, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS members FROM supplier WHERE s_acctbal>0 GROUP BY 1 UNION ALL SELECT s_nationkey, s_suppkey::VARCHAR FROM supplier WHERE NOT s_acctbal>0")
def collapse(spark, d):
    out = ro.collapse(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation"), ["nation"], F.col("s_acctbal") > 0, "s_suppkey")
    return out.select("nation", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@register("matrix_guard", """WITH x AS (SELECT unnest([{c:'l_quantity',v:CASE WHEN l_linenumber=7 THEN NULL ELSE l_quantity END},{c:'l_extendedprice',v:l_extendedprice},{c:'zero',v:0.0}]) x FROM lineitem)
SELECT x.c AS "column", count(*)-count(x.v) AS n_bad, max(abs(x.v)) AS max_abs, max(abs(x.v))=0 AS all_zero, max(abs(x.v))>60000 AS overflow FROM x GROUP BY 1""")
def matrix_guard(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_quantity"))).withColumn("zero", F.lit(0.0))
    return ro.matrix_guard(li, ["l_quantity", "l_extendedprice", "zero"], 60000)


@register("column_moments", "SELECT count(*) AS n, round(avg(l_quantity),5) AS l_quantity_mean, round(stddev_pop(l_quantity),5) AS l_quantity_std, round(avg(l_tax),6) AS l_tax_mean, round(stddev_pop(l_tax),6) AS l_tax_std FROM lineitem")
def column_moments(spark, d):
    out = ro.moments(table(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    return out.select("n", *[F.round(c, 5 if "quantity" in c else 6).alias(c) for c in out.columns[1:]])


@register("recall_comparison", """SELECT l_returnflag AS "class", count(*) AS support, round(avg((l_returnflag=CASE WHEN l_quantity>25 THEN 'A' ELSE 'N' END)::INT),6) AS baseline, round(avg((l_returnflag=CASE WHEN l_shipdate>=TIMESTAMP '1995-06-17' THEN 'N' ELSE 'A' END)::INT),6) AS augmented,
 round(avg((l_returnflag=CASE WHEN l_shipdate>=TIMESTAMP '1995-06-17' THEN 'N' ELSE 'A' END)::INT)-avg((l_returnflag=CASE WHEN l_quantity>25 THEN 'A' ELSE 'N' END)::INT),6) AS gain FROM lineitem GROUP BY 1""")
def recall_comparison(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 25, "A").otherwise("N").alias("one"), F.when(F.col("l_shipdate") >= F.lit("1995-06-17").cast("timestamp"), "N").otherwise("A").alias("two"))
    return rounded(ro.recall_comparison(li, "l_returnflag", "one", "two"), 6)


@register("compare_results", """WITH a AS (SELECT o_orderkey k, o_totalprice v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 5=0 THEN o_totalprice+1 ELSE o_totalprice END v FROM orders WHERE o_orderkey % 4 <> 0)
SELECT k AS o_orderkey, a.v AS first, b.v AS second, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'added' WHEN abs(a.v-b.v)<=1e-6 THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b USING(k)""")
def compare_results(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    other = o.where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return ro.compare_results(o.where("o_orderkey % 3 <> 0"), other, "o_orderkey", "o_totalprice")


@register("anomaly_flags", """SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_tax<0.05 AND abs(l_discount)<0.02 THEN 'significant but tiny' END, CASE WHEN l_tax>=0.05 AND abs(l_discount)>0.08 THEN 'large but not significant' END, CASE WHEN l_tax=0 OR l_tax=1 THEN 'degenerate p' END, CASE WHEN l_quantity/40>1 THEN 'high variation' END) AS flags FROM lineitem""")
def anomaly_flags(spark, d):
    out = ro.anomaly_flags(table(spark, d, "lineitem").withColumn("cv", F.col("l_quantity") / 40), "l_tax", "l_discount", "cv", 0.02, 0.08)
    return out.select("l_orderkey", "l_linenumber", F.array_join("flags", ";").alias("flags"))


@register("cross_row_patterns", """WITH s AS (SELECT l_orderkey o, l_extendedprice n, l_discount-0.03 e, l_tax*10 p FROM lineitem), t AS (SELECT *, e-lag(e) OVER (PARTITION BY o ORDER BY n) st FROM s)
SELECT o AS l_orderkey, count(*) AS n, count(*)>=3 AND (bool_and(e>0) OR bool_and(e<0)) AS one_sign, count(*)>=4 AND (bool_and(st>0) OR bool_and(st<0)) AS monotone, count(*)>=5 AND count(*) FILTER (WHERE p<0.05)>0 AND count(*) FILTER (WHERE p>0.5)>0 AND count(*) FILTER (WHERE p BETWEEN 0.05 AND 0.5)=0 AS bimodal_p FROM t GROUP BY 1""")
def cross_row_patterns(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", (F.col("l_discount") - 0.03).alias("e"), (F.col("l_tax") * 10).alias("p"))
    return ro.cross_row_patterns(li, "l_orderkey", "l_extendedprice", "e", "p")


@register("coalesce_duplicates", """WITH s AS (SELECT page_id, regexp_extract(url,'//([^/]+)/',1) host, CASE WHEN page_id%3=0 THEN '' ELSE url END u, length(html) n FROM pages)
SELECT host, arg_min(nullif(trim(u),''), CASE WHEN trim(u)<>'' THEN page_id END) AS u, max(n) AS n FROM s GROUP BY 1""")
def coalesce_duplicates(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)/", 1).alias("host"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("u"), F.length("html").cast("long").alias("n"))
    return ro.coalesce_duplicates(pages, "host", "page_id", ["u"], ["n"])


@register("set_call", """WITH s AS (SELECT l_orderkey o, l_returnflag f, l_discount*100 a FROM lineitem), g AS (SELECT o, count(DISTINCT f) FILTER (WHERE a>0) k, min(f) FILTER (WHERE a>0) f, round(sum(a),4) total FROM s GROUP BY 1)
SELECT o AS l_orderkey, CASE WHEN k=0 THEN 'none' WHEN k=1 THEN f ELSE 'multiple' END AS "call", total FROM g""")
def set_call(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_discount") * 100).alias("a"))
    return rounded(ro.set_call(li, "l_orderkey", "l_returnflag", "a"))


@register("inverted_sets", "WITH w AS (SELECT DISTINCT p_partkey k, unnest(string_split(p_name,' ')) i FROM part) SELECT i AS item, md5(string_agg(DISTINCT k::VARCHAR, ';' ORDER BY k::VARCHAR)) AS keys FROM w WHERE trim(i)<>'' GROUP BY 1")
def inverted_sets(spark, d):
    return ro.inverted_sets(table(spark, d, "part"), "p_partkey", "p_name", " ").withColumn("keys", F.md5("keys"))


@register("sums_top", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 25")
def sums_top(spark, d):
    return rounded(ro.sums_top(table(spark, d, "orders"), "o_custkey", "o_totalprice", 25), 2)


@register("coverage_ratio", "WITH n AS (SELECT DISTINCT c_custkey k FROM customer), o AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus='P') SELECT count(*) AS named, count(o.k) AS known, count(o.k)/count(*) AS coverage FROM n LEFT JOIN o USING(k)")
def coverage_ratio(spark, d):
    return ro.coverage(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey")


@register("screen_summary", """WITH s AS (SELECT o_orderkey k, CASE WHEN o_orderkey%5=0 THEN o_orderstatus || '+' || substr(o_orderpriority,1,1) ELSE o_orderstatus END c FROM orders), g AS (SELECT c, count(DISTINCT k) n FROM s GROUP BY 1)
SELECT sum(n)::BIGINT AS n_cells, coalesce(sum(n) FILTER (WHERE c='O'),0)::BIGINT AS n_controls, count(*) FILTER (WHERE c<>'O' AND NOT contains(c,'+')) AS n_single, count(*) FILTER (WHERE contains(c,'+')) AS n_combined, min(n) FILTER (WHERE c<>'O') AS least_cells FROM g""")
def screen_summary(spark, d):
    o = table(spark, d, "orders")
    label = F.when(F.col("o_orderkey") % 5 == 0, F.concat("o_orderstatus", F.lit("+"), F.substring("o_orderpriority", 1, 1))).otherwise(F.col("o_orderstatus"))
    return ro.screen_summary(o.select("o_orderkey", label.alias("c")), "o_orderkey", "c", "O")


@register("unit_cost", "SELECT count(*) AS n, round(avg((o_orderstatus<>'O')::INT),6) AS saturation, round(avg((o_totalprice>300000)::INT),6) AS discovery_rate, round(sum(o_totalprice),2) AS cost, count(*) FILTER (WHERE o_totalprice>300000) AS good, round(sum(o_totalprice)/nullif(count(*) FILTER (WHERE o_totalprice>300000),0),2) AS cost_per_good FROM orders")
def unit_cost(spark, d):
    out = ro.unit_cost(table(spark, d, "orders"), F.col("o_orderstatus") != "O", F.col("o_totalprice") > 300000, "o_totalprice")
    return out.select("n", F.round("saturation", 6).alias("saturation"), F.round("discovery_rate", 6).alias("discovery_rate"), F.round("cost", 2).alias("cost"), "good", F.round("cost_per_good", 2).alias("cost_per_good"))


@register("year_profile", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def year_profile(spark, d):
    return table(spark, d, "orders").where("o_orderdate IS NOT NULL").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("graph_statistics", """SELECT 'node' AS kind, 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'node','supplier',count(*) FROM supplier UNION ALL SELECT 'node','part',count(*) FROM part
UNION ALL SELECT 'edge', 'sold_' || l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag""")
def graph_statistics(spark, d):
    nodes = [table(spark, d, t).select(F.lit("node").alias("kind"), F.lit(t).alias("label")) for t in ("customer", "supplier", "part")]
    rows = nodes[0].union(nodes[1]).union(nodes[2]).union(table(spark, d, "lineitem").select(F.lit("edge"), F.concat(F.lit("sold_"), "l_returnflag")))
    return rows.groupBy("kind", "label").agg(F.count("*").alias("n"))


@register("category_leaders", "SELECT p_brand, count(*) AS n, arg_max(p_partkey,(p_retailprice,p_partkey)) AS dearest, arg_max(p_partkey,(p_size,p_partkey)) AS largest FROM part GROUP BY 1")
def category_leaders(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("dearest"), F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("largest"))
