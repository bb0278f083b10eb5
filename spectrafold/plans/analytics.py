"""Joins, rankings, graphs, matrices, features, vectors and event windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators import cleaning as c
from spectrafold.operators import features as ft
from spectrafold.operators import matrix as mx
from spectrafold.operators import relations as r
from spectrafold.operators import vector_search as vs
from spectrafold.operators.permutation import empirical_p, label_permutations, shuffle_residuals
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table
from spectrafold.streaming import events as ev


@register("barcode_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def barcode_join(spark, d):
    left = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("BC"), "c_custkey", F.lit("-1")).alias("barcode"))
    right = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("BC"), "o_custkey").alias("barcode"))
    return r.barcode_join(left, right, "barcode", "barcode").select("c_custkey", "o_orderkey", "o_totalprice")


@register("key_overlap", """WITH l AS (SELECT DISTINCT c_custkey k FROM customer), o AS (SELECT DISTINCT o_custkey k FROM orders WHERE o_orderstatus='F'), n AS (SELECT (SELECT count(*) FROM l) a, (SELECT count(*) FROM o) b, (SELECT count(*) FROM l JOIN o USING(k)) s)
SELECT a AS n_left, b AS n_right, s AS shared, round(s/least(a,b),6) AS overlap, round(s/(a+b-s),6) AS jaccard FROM n""")
def key_overlap(spark, d):
    return rounded(r.key_overlap(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'"), "c_custkey", "o_custkey"), 6)


@register("multi_lookup", """SELECT p_partkey, sold, last_ship, dear FROM part
LEFT JOIN (SELECT l_partkey p_partkey, round(sum(l_quantity),4) sold FROM lineitem WHERE l_returnflag='A' GROUP BY 1) USING (p_partkey)
LEFT JOIN (SELECT l_partkey p_partkey, max(l_shipdate) last_ship FROM lineitem WHERE l_returnflag='R' GROUP BY 1) USING (p_partkey)
LEFT JOIN (SELECT l_partkey p_partkey, count(*) dear FROM lineitem WHERE l_extendedprice > 50000 GROUP BY 1) USING (p_partkey)""")
def multi_lookup(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    sides = [
        li.where("l_returnflag = 'A'").groupBy("p_partkey").agg(F.round(F.sum("l_quantity"), 4).alias("sold")),
        li.where("l_returnflag = 'R'").groupBy("p_partkey").agg(F.max("l_shipdate").alias("last_ship")),
        li.where("l_extendedprice > 50000").groupBy("p_partkey").agg(F.count("*").alias("dear")),
    ]
    return r.lookup(table(spark, d, "part").select("p_partkey"), "p_partkey", *sides)


@register("role_overlap", "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def role_overlap(spark, d):
    return r.overlap_violations(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag").withColumn("roles", F.array_join("roles", ","))


@register("cooccurrence", """WITH b AS (SELECT DISTINCT l_orderkey o, p_brand b FROM lineitem JOIN part ON l_partkey=p_partkey)
SELECT x.b AS a, y.b AS b, count(*) AS n_groups FROM b x JOIN b y ON x.o=y.o AND x.b<y.b GROUP BY 1,2 HAVING count(*)>=5""")
def cooccurrence(spark, d):
    sold = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return r.cooccurrence(sold, "l_orderkey", "p_brand", 5)


@register("token_pairs", """WITH t AS (SELECT min(p_partkey) id, s FROM (SELECT p_partkey, list_sort(list_distinct(regexp_split_to_array(lower(trim(p_name || ' ' || p_type || ' ' || p_brand)), '\\s+'))) s FROM part) GROUP BY s),
 e AS (SELECT id, len(s) n, unnest(s) t FROM t)
SELECT a.id AS id, b.id AS other, round(count(*)/(any_value(a.n)+any_value(b.n)-count(*)),6) AS similarity FROM e a JOIN e b ON a.t=b.t AND a.id<b.id GROUP BY 1,2 HAVING count(*)/(any_value(a.n)+any_value(b.n)-count(*)) >= 0.7""")
def token_pairs(spark, d):
    parts = table(spark, d, "part").withColumn("said", F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return rounded(r.token_pairs(parts, "p_partkey", "said", 0.7), 6)


@register("first_key_dedup", """WITH k AS (SELECT page_id, CASE WHEN trim(coalesce(u,'')) <> '' THEN '0:' || lower(trim(u)) WHEN trim(coalesce(t,'')) <> '' THEN '1:' || lower(trim(t)) END k
 FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(url, '//([^/]+)/', 1) END u, regexp_extract(html, '<title>([^<]*)</title>', 1) t FROM pages))
SELECT min(page_id) AS page_id FROM k WHERE k IS NOT NULL GROUP BY k""")
def first_key_dedup(spark, d):
    pages = table(spark, d, "pages")
    host = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.regexp_extract("url", "//([^/]+)/", 1))
    return r.first_key_dedup(pages, [host, F.regexp_extract("html", "<title>([^<]*)</title>", 1)], "page_id").select("page_id")


@register("exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS digest FROM documents GROUP BY text")
def exact_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@register("title_keys", r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_extract(html,'<h1>([^<]*)</h1>',1)),'[^\p{L}\p{N}_\s]','','g'),'\s+',' ','g')) AS title_key FROM pages")
def title_keys(spark, d):
    return table(spark, d, "pages").select("page_id", r.title_key(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title_key"))


@register("weighted_rank", """WITH s AS (SELECT l_suppkey, avg(l_discount)*5 a, avg(l_tax)*5 b, avg(CASE WHEN l_returnflag='R' THEN 1.0::DOUBLE ELSE 0 END) x FROM lineitem GROUP BY 1),
 t AS (SELECT l_suppkey, round(greatest(least(0.5*a+0.3*b+0.2*x,1.0),0.0),9) score FROM s)
SELECT l_suppkey, score, row_number() OVER (ORDER BY score DESC, l_suppkey)::INT AS rank FROM t""")
def weighted_rank(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") * 5).alias("a"), (F.avg("l_tax") * 5).alias("b"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("x"))
    total = s.select("l_suppkey", F.round(0.5 * F.col("a") + 0.3 * F.col("b") + 0.2 * F.col("x"), 9).alias("total"))
    return r.weighted_rank(total, {"total": 1.0}, "l_suppkey").select("l_suppkey", "score", "rank")


_DAILY = "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value),4) AS mean FROM events GROUP BY 1,2"


def _daily(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@register("daily_metrics", _DAILY.replace("date_trunc('day', ts) AS day", "date_trunc('day', ts)::TIMESTAMP AS day"))
def daily_metrics(spark, d):
    return _daily(spark, d)


@register("trailing_window", f"""WITH s AS ({_DAILY}), t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) k, lag(mean) OVER (PARTITION BY event_type ORDER BY day DESC) nx FROM s)
SELECT event_type, count(*) AS n, max(mean) < 60 AS all_below, coalesce(bool_and(nx <= mean) FILTER (WHERE k > 1), true) AS never_rises FROM t WHERE k <= 3 GROUP BY 1""")
def trailing_window(spark, d):
    return r.trailing(_daily(spark, d), "event_type", "day", "mean", 3, 60.0)


@register("run_since_success", """WITH l AS (SELECT user_id, max(CASE WHEN event_type='purchase' THEN event_id END) m FROM events GROUP BY 1)
SELECT user_id, count(*) FILTER (WHERE m IS NULL OR event_id > m) AS run_length FROM events JOIN l USING(user_id) GROUP BY 1""")
def run_since_success(spark, d):
    return r.run_since(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase")


@register("quintile_stage", """WITH s AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus='F'), q AS (SELECT quantile_cont(o_totalprice,0.2) a, quantile_cont(o_totalprice,0.4) b, quantile_cont(o_totalprice,0.6) c, quantile_cont(o_totalprice,0.8) e FROM s)
SELECT o_orderkey, (1+(o_totalprice>=a)::INT+(o_totalprice>=b)::INT+(o_totalprice>=c)::INT+(o_totalprice>=e)::INT)::INT AS stage FROM s, q""")
def quintile_stage(spark, d):
    return r.quintile_stage(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice", F.col("o_orderstatus") == "F").select("o_orderkey", "stage")


@register("stratified_split", """WITH p AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR)) k, count(*) OVER (PARTITION BY c_mktsegment) n FROM customer)
SELECT c_custkey, CASE WHEN k <= least(round_even(n*0.2,0), n-1) THEN 'test' ELSE 'train' END AS split FROM p""")
def stratified_split(spark, d):
    return r.stratified_split(table(spark, d, "customer"), "c_custkey", "c_mktsegment", 0.2).select("c_custkey", "split")


@register("proportional_sample", """WITH p AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR)) k, count(*) OVER (PARTITION BY event_type) n, count(*) OVER () t FROM events)
SELECT event_id, event_type FROM p WHERE k <= greatest(1, round_even(500*n/t,0))""")
def proportional_sample(spark, d):
    return r.proportional_sample(table(spark, d, "events"), "event_id", "event_type", 500).select("event_id", "event_type")


@register("dominant_category", """WITH s AS (SELECT c_custkey, c_mktsegment, l_returnflag, sum(l_quantity) a FROM customer JOIN orders ON c_custkey=o_custkey JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1,2,3),
 b AS (SELECT c_custkey, arg_max(l_returnflag, (a, l_returnflag)) AS top, max(a) AS top_amount, sum(a) AS total FROM s GROUP BY 1)
SELECT c_custkey, top, round(top_amount,4) AS top_amount, round(total,4) AS total, CASE WHEN top_amount >= 100 AND top_amount >= 0.4*total THEN top ELSE 'ambiguous' END AS call FROM b""")
def dominant_category(spark, d):
    sold = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rounded(r.dominant(sold, "c_custkey", "l_returnflag", "l_quantity", 100, 0.4))


@register("collected_sets", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, count(*) AS n FROM orders GROUP BY 1")
def collected_sets(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"), F.count("*").alias("n"))


_EDGES = "SELECT DISTINCT a.l_suppkey src, b.l_suppkey dst FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND a.l_suppkey<>b.l_suppkey"


def _edges(spark, d):
    big = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("src")).distinct()
    return big.join(big.withColumnRenamed("src", "dst"), "l_orderkey").where("src <> dst").select("src", "dst").distinct()


@register("graph_hops", f"""WITH e AS ({_EDGES}), h1 AS (SELECT DISTINCT dst n FROM e WHERE src=1), h2 AS (SELECT DISTINCT e.dst n FROM h1 JOIN e ON e.src=h1.n WHERE e.dst<>1 AND e.dst NOT IN (SELECT n FROM h1)),
 h3 AS (SELECT DISTINCT e.dst n FROM h2 JOIN e ON e.src=h2.n WHERE e.dst<>1 AND e.dst NOT IN (SELECT n FROM h1) AND e.dst NOT IN (SELECT n FROM h2))
SELECT 1::BIGINT AS root, n AS node, 1 AS distance FROM h1 UNION ALL SELECT 1, n, 2 FROM h2 UNION ALL SELECT 1, n, 3 FROM h3""")
def graph_hops(spark, d):
    start = table(spark, d, "supplier").where("s_suppkey = 1").select(F.col("s_suppkey").alias("node"))
    return r.hops(_edges(spark, d), start, 3)


@register("graph_degrees", f"WITH e AS ({_EDGES}) SELECT src AS id, count(*) AS out_degree, (SELECT count(*) FROM e f WHERE f.dst=e.src) AS in_degree FROM e GROUP BY src")
def graph_degrees(spark, d):
    e = _edges(spark, d)
    return e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")).join(e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")), "id", "left")


@register("pagerank", f"""WITH e AS ({_EDGES}), o AS (SELECT src, count(*) deg FROM e GROUP BY 1), v AS (SELECT src id FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) n FROM v),
 r0 AS (SELECT id, 1.0::DOUBLE/n r FROM v, c),
 r1 AS (SELECT v.id, 0.15/n + 0.85*coalesce((SELECT sum(r/deg) FROM e JOIN r0 ON r0.id=e.src JOIN o ON o.src=e.src WHERE e.dst=v.id),0) r FROM v, c),
 r2 AS (SELECT v.id, 0.15/n + 0.85*coalesce((SELECT sum(r/deg) FROM e JOIN r1 ON r1.id=e.src JOIN o ON o.src=e.src WHERE e.dst=v.id),0) r FROM v, c)
SELECT id, round(r,8) AS rank FROM r2""")
def pagerank(spark, d):
    return rounded(r.pagerank(_edges(spark, d), rounds=2), 8)


@register("top_neighbours", """WITH e AS (SELECT o_custkey src, l_suppkey dst, round(sum(l_extendedprice),2) weight FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1,2)
SELECT src, dst, weight FROM e WHERE weight > 1000 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) <= 3""")
def top_neighbours(spark, d):
    sold = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = sold.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.round(F.sum("l_extendedprice"), 2).alias("weight"))
    return r.top_neighbours(edges, 3, 1000.0)


_COO = "SELECT l_orderkey cell, l_suppkey gene, sum(l_quantity) value FROM lineitem GROUP BY 1,2"
_NORM = f"WITH c AS ({_COO}), t AS (SELECT cell, sum(value) total FROM c GROUP BY 1), x AS (SELECT cell, gene, ln(1+value/total*1e4) value FROM c JOIN t USING(cell)), n AS (SELECT count(*) n FROM t)"
_MOMENTS = _NORM + ", m AS (SELECT gene, count(*) FILTER (WHERE value>0) detected, sum(value)/any_value(n) mean, sum(value*value)/any_value(n)-pow(sum(value)/any_value(n),2) var FROM x, n GROUP BY 1)"


def _coo(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def _cells(coo):
    return coo.agg(F.count_distinct("cell").alias("n"))


@register("library_normalize", f"{_NORM} SELECT cell, gene, round(value,6) AS value FROM x")
def library_normalize(spark, d):
    return rounded(mx.library_normalize(_coo(spark, d)), 6)


@register("variable_genes", f"{_MOMENTS} SELECT gene, detected, round(mean,6) AS mean, round(var,6) AS variance, round(var/mean,6) AS dispersion FROM m WHERE detected>=3 ORDER BY var/mean DESC, gene LIMIT 20")
def variable_genes(spark, d):
    coo = _coo(spark, d)
    return rounded(mx.variable_genes(mx.library_normalize(coo), _cells(coo), 20), 6)


@register("clipped_scores", f"{_MOMENTS} SELECT cell, gene, round(greatest((value-mean)/CASE WHEN var>0 THEN sqrt(var) ELSE 1 END,0),5) AS value FROM x JOIN m USING(gene)")
def clipped_scores(spark, d):
    coo = _coo(spark, d)
    return rounded(mx.clipped_scores(mx.library_normalize(coo), _cells(coo)), 5)


@register("pseudobulk_delta", f"""WITH c AS ({_COO}), l AS (SELECT o_orderkey cell, o_orderstatus AS label FROM orders), z AS (SELECT label, count(*) n FROM l GROUP BY 1),
 p AS (SELECT label, gene, sum(value)/any_value(n) mean FROM c JOIN l USING(cell) JOIN z USING(label) GROUP BY 1,2), g AS (SELECT DISTINCT gene FROM p)
SELECT z.label, g.gene, round(coalesce(p.mean,0)-coalesce(b.mean,0),6) AS delta FROM g CROSS JOIN z LEFT JOIN p ON p.gene=g.gene AND p.label=z.label LEFT JOIN p b ON b.gene=g.gene AND b.label='F' WHERE z.label<>'F'""")
def pseudobulk_delta(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderstatus").alias("label"))
    return rounded(mx.delta(mx.pseudobulk(_coo(spark, d), labels), "F"), 6)


@register("label_encode", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority)-1)::INT AS code FROM orders")
def label_encode(spark, d):
    return ft.label_encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@register("one_hot", """SELECT c_custkey, (c_mktsegment='BUILDING')::INT AS "c_mktsegment=BUILDING", (c_mktsegment='MACHINERY')::INT AS "c_mktsegment=MACHINERY", (c_mktsegment NOT IN ('BUILDING','MACHINERY'))::INT AS "c_mktsegment=<unknown>" FROM customer""")
def one_hot(spark, d):
    return ft.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"]).drop("c_mktsegment")


@register("median_impute", """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END v FROM customer), f AS (SELECT c_custkey, coalesce(v, (SELECT quantile_cont(v,0.5) FROM s)) v FROM s)
SELECT c_custkey, round((v-avg(v) OVER ())/stddev_pop(v) OVER (),6) AS v FROM f""")
def median_impute(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"))
    return rounded(ft.median_impute(df, "v"), 6)


@register("class_metrics", """WITH s AS (SELECT l_returnflag t, CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN CASE WHEN l_quantity>25 THEN 'A' ELSE 'R' END ELSE 'N' END g FROM lineitem)
SELECT t AS class, count(*) AS support, round(coalesce(count(*) FILTER (WHERE t=g)/nullif((SELECT count(*) FROM s x WHERE x.g=s.t),0),0),6) AS precision, round(count(*) FILTER (WHERE t=g)/count(*),6) AS recall,
 round(2.0*count(*) FILTER (WHERE t=g)/(count(*)+(SELECT count(*) FROM s x WHERE x.g=s.t)),6) AS f1 FROM s GROUP BY t""")
def class_metrics(spark, d):
    guess = F.when(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp"), F.when(F.col("l_quantity") > 25, "A").otherwise("R")).otherwise("N")
    return rounded(ft.class_metrics(table(spark, d, "lineitem").select("l_returnflag", guess.alias("guess")), "l_returnflag", "guess"), 6)


@register("regression_metrics", """WITH s AS (SELECT l_extendedprice t, l_quantity*1500 g FROM lineitem)
SELECT count(*) AS n, round(avg((t-g)**2),3) AS mse, round(sqrt(avg((t-g)**2)),3) AS rmse, round(avg(abs(t-g)),3) AS mae, round(1-avg((t-g)**2)/var_pop(t),3) AS r2, round(avg(t-g),3) AS residual_mean, round(stddev_pop(t-g),3) AS residual_std FROM s""")
def regression_metrics(spark, d):
    df = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return rounded(ft.regression_metrics(df, "l_extendedprice", "guess"), 3)


@register("cosine_neighbours", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_cosine_similarity(q.e, v.e),6) AS similarity FROM v q JOIN v ON q.vec_id<>v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) <= 5""")
def cosine_neighbours(spark, d):
    """A stated query set against all vectors by blocks; vectors of another length or without a direction are met one by one."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("vec_id IS NOT NULL")
    v = v.withColumn("norm", F.sqrt(dot("e", "e")))
    directed = F.coalesce((F.col("norm") > 1e-100) & (F.col("norm") < 1e100), F.lit(False))
    told = v.agg(F.min(F.size("e")).alias("least"), F.max(F.size("e")).alias("most"), F.count_if(~directed).alias("odd")).first()
    v = v.withColumn("whole", directed & (F.size("e") == F.lit(told.most)))
    pairs = vs.scan(v.where("whole").select(F.col("vec_id").alias("id"), "e"), F.col("id") % 100 == 0, 5)
    if told.odd or told.least != told.most:
        q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("qe"), F.col("norm").alias("qn"), F.col("whole").alias("q_whole"))
        rest = q.join(v, (F.col("query_id") != F.col("vec_id")) & ~(F.col("q_whole") & F.col("whole")))
        pairs = pairs.union(rest.select("query_id", "vec_id", (dot("qe", "e") / (F.col("qn") * F.col("norm"))).alias("s")))
    best = c.top_per_group(pairs, ["query_id"], [F.desc("s"), F.col("vec_id")], 5)
    return best.select("query_id", "vec_id", F.round("s", 6).alias("similarity"))


@register("permutation_test", """WITH s AS (SELECT s_suppkey, s_acctbal v, s_nationkey < 12 g FROM supplier), o AS (SELECT avg(v) FILTER (WHERE g) - avg(v) FILTER (WHERE NOT g) x, count(*) FILTER (WHERE g) k FROM s),
 b AS (SELECT unnest(range(1,100)) b), p AS (SELECT b, v, row_number() OVER (PARTITION BY b ORDER BY md5(s_suppkey::VARCHAR || ':' || b::VARCHAR)) r FROM s, b),
 n AS (SELECT b, avg(v) FILTER (WHERE r<=k) - avg(v) FILTER (WHERE r>k) x FROM p, o GROUP BY b)
SELECT round(any_value(o.x),4) AS observed, count(*) AS shuffles, (count(*) FILTER (WHERE abs(n.x)>=abs(o.x))+1)/(count(*)+1)::DOUBLE AS p FROM n, o""")
def permutation_test(spark, d):
    """Label shuffles by a keyed hash."""
    permuted = label_permutations(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", F.col("s_nationkey") < 12, 99)
    return empirical_p(permuted).select(F.round("observed", 4).alias("observed"), "shuffles", "p")


@register("permutation_welch", """WITH s AS (SELECT o_orderkey, o_totalprice::DOUBLE v, o_orderpriority IN ('1-URGENT','2-HIGH') g FROM orders), k AS (SELECT count(*) FILTER (WHERE g) k FROM s), b AS (SELECT unnest(range(0,20)) b),
 p AS (SELECT b, v, CASE WHEN b=0 THEN g ELSE row_number() OVER (PARTITION BY b ORDER BY md5(o_orderkey::VARCHAR || ':' || b::VARCHAR)) <= k END h FROM s, b, k),
 n AS (SELECT b, (avg(v) FILTER (WHERE h) - avg(v) FILTER (WHERE NOT h))/sqrt(var_samp(v) FILTER (WHERE h)/count(*) FILTER (WHERE h) + var_samp(v) FILTER (WHERE NOT h)/count(*) FILTER (WHERE NOT h)) t FROM p GROUP BY b)
SELECT b AS draw, round(t,6) AS statistic FROM n""")
def permutation_welch(spark, d):
    label = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return label_permutations(table(spark, d, "orders"), "o_orderkey", "o_totalprice", label, 19, "welch_t").select("draw", F.round("statistic", 6).alias("statistic"))


@register("residual_shuffle", """WITH p AS (SELECT p_partkey, p_size::DOUBLE x, p_retailprice::DOUBLE y FROM part), f AS (SELECT regr_slope(y,x) b, regr_intercept(y,x) a FROM p),
 r AS (SELECT p_partkey, a+b*x fit, y-(a+b*x) e, row_number() OVER (ORDER BY p_partkey) i, row_number() OVER (ORDER BY md5('0:__residual:' || p_partkey::VARCHAR)) j FROM p, f)
SELECT r.p_partkey, round(r.fit+s.e,4) AS y FROM r JOIN r s ON r.i=s.j""")
def residual_shuffle(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"))
    line = p.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    fitted = p.crossJoin(F.broadcast(line)).select("p_partkey", "y", (F.col("a") + F.col("b") * F.col("x")).alias("fit"))
    return shuffle_residuals(fitted, "p_partkey", "y", "fit").select("p_partkey", F.round("y", 4).alias("y"))


@register("sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END n, event_id FROM events),
 k AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM s)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM k GROUP BY user_id, k""")
def sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w)) <= F.expr("INTERVAL 30 MINUTES"), F.lit(False))
    marked = table(spark, d, "events").withColumn("k", F.when(gap, 0).otherwise(1))
    return marked.withColumn("k", F.sum("k").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("user_id", "k").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n")).drop("k")


@register("conversation_stats", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)),4) AS mean_chars, max(turn) AS last_turn FROM conversations GROUP BY role")
def conversation_stats(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max("turn").alias("last_turn"))


@register("decayed_top", "SELECT o_orderkey, round(o_totalprice/(date_diff('day', o_orderdate::DATE, DATE '2030-01-01')+1),6) AS rank_score FROM orders ORDER BY o_totalprice/(date_diff('day', o_orderdate::DATE, DATE '2030-01-01')+1) DESC, o_orderkey LIMIT 25")
def decayed_top(spark, d):
    return c.decayed_top(table(spark, d, "orders"), "o_totalprice", "o_orderdate", F.lit("2030-01-01").cast("timestamp"), 25).select("o_orderkey", F.round("rank_score", 6).alias("rank_score"))


_HOURS = "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, round(sum(value),4) AS total, round(avg(value),4) AS mean FROM events GROUP BY 1,2,3"


@register("windowed_events", _HOURS)
def windowed_events(spark, d):
    return rounded(ev.windowed(table(spark, d, "events")))


@register("budget_periods")
def budget_periods(spark, d):
    return rounded(ev.budget_periods(table(spark, d, "events"), "event_type", "ts", "value", 7))
