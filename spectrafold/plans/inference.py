"""Tests with p-values, intervals, fits, power, resampling and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import inference as i
from spectrafold.operators import statistics as s
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table

_SIMPSON = "list_sum(list_transform(range(2001), lambda j: (CASE WHEN j IN (0,2000) THEN 1 WHEN j%2=1 THEN 4 ELSE 2 END)*({f})))"


def _t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t by Simpson's rule in the angle."""
    area = _SIMPSON.format(f=f"pow(cos(atan(abs({t})/sqrt({df}))*j/2000), {df}-1)")
    return f"greatest(0, 1-2*exp(lgamma(({df}+1)/2.0)-lgamma({df}/2.0))/sqrt(pi())*atan(abs({t})/sqrt({df}))/6000*{area})"


def _z_p(z: str) -> str:
    return f"greatest(0, 1-2/sqrt(2*pi())*abs({z})/6000*{_SIMPSON.format(f=f'exp(-pow({z}*j/2000,2)/2)')})"


def _urgent(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_nationkey") % 2).alias("g"))


_S = "SELECT s_suppkey, s_acctbal v, s_nationkey, s_nationkey%2 g FROM supplier"


@register("t_test_p", f"""WITH m AS (SELECT count(*) FILTER (WHERE g=0) a, count(*) FILTER (WHERE g=1) b, avg(v) FILTER (WHERE g=0) x, avg(v) FILTER (WHERE g=1) y, var_samp(v) FILTER (WHERE g=0) u, var_samp(v) FILTER (WHERE g=1) w FROM ({_S})),
 t AS (SELECT (x-y)/sqrt(((a-1)*u+(b-1)*w)/(a+b-2)*(1.0/a+1.0/b)) t, a+b-2 df FROM m) SELECT round(t,6) AS t, df, round({_t_p('t', 'df')},6) AS p FROM t""")
def t_test_p(spark, d):
    return rounded(s.with_p(s.t_test(_urgent(spark, d), "g", "s_acctbal", 0, 1), "t").select("t", "df", "p"), 6)


@register("correlation_p", f"WITH m AS (SELECT count(*) n, corr(s_nationkey, v) r FROM ({_S})) SELECT n, round(r,6) AS r, round({_t_p('(r*sqrt((n-2)/(1-r*r)))', '(n-2)')},6) AS p FROM m")
def correlation_p(spark, d):
    return rounded(s.with_p(s.linear_fit(_urgent(spark, d), "s_nationkey", "s_acctbal").select("n", "r"), "r"), 6)


@register("correlation_pairs", f"""WITH c AS (SELECT unnest([{{a:'s_suppkey',b:'s_nationkey',x:s_suppkey::DOUBLE,y:s_nationkey::DOUBLE}},{{a:'s_suppkey',b:'s_acctbal',x:s_suppkey::DOUBLE,y:v}},{{a:'s_nationkey',b:'s_acctbal',x:s_nationkey::DOUBLE,y:v}}]) c FROM ({_S})),
 m AS (SELECT c.a a, c.b b, count(*) n, corr(c.x,c.y) r FROM c GROUP BY 1,2) SELECT a AS first, b AS second, n, round(r,6) AS r, round({_t_p('(r*sqrt((n-2)/(1-r*r)))', '(n-2)')},6) AS p FROM m""")
def correlation_pairs(spark, d):
    return rounded(i.correlation_pairs(table(spark, d, "supplier"), ["s_suppkey", "s_nationkey", "s_acctbal"]), 6)


_RANKED = "SELECT (SELECT count(*) FILTER (WHERE o.{c}<s.{c}) + (count(*) FILTER (WHERE o.{c}=s.{c})+1)/2.0 FROM supplier o)"


@register("spearman", f"WITH r AS (SELECT ({_RANKED.format(c='s_nationkey')}) a, ({_RANKED.format(c='s_acctbal')}) b FROM supplier s), m AS (SELECT count(*) n, corr(a,b) r FROM r) SELECT n, round(r,6) AS r, round({_t_p('(r*sqrt((n-2)/(1-r*r)))', '(n-2)')},6) AS p FROM m")
def spearman(spark, d):
    return rounded(i.spearman(table(spark, d, "supplier"), "s_nationkey", "s_acctbal"), 6)


@register("mann_whitney_p", f"""WITH r AS (SELECT g, ({_RANKED.format(c='s_acctbal')}) r FROM (SELECT *, s_nationkey%2 g FROM supplier) s), m AS (SELECT count(*) FILTER (WHERE g=0)::DOUBLE a, count(*) FILTER (WHERE g=1)::DOUBLE b, sum(r) FILTER (WHERE g=0) q FROM r),
 z AS (SELECT q-a*(a+1)/2 u, (q-a*(a+1)/2-a*b/2)/sqrt(a*b/12*(a+b+1)) z FROM m) SELECT u, round(z,6) AS z, round({_z_p('z')},6) AS p FROM z""")
def mann_whitney_p(spark, d):
    return rounded(s.with_p(s.mann_whitney(_urgent(spark, d), "g", "s_acctbal", 0, 1), "u").select("u", "z", "p"), 6)


@register("chi_square_p", """WITH c AS (SELECT o_orderpriority r, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END c, count(*) o FROM orders GROUP BY 1,2), e AS (SELECT o, sum(o) OVER (PARTITION BY r)*sum(o) OVER (PARTITION BY c)/sum(o) OVER () e FROM c), x AS (SELECT sum((o-e)*(o-e)/e) x FROM e)
SELECT round(x,6) AS chi2, 4 AS dof, round(exp(-x/2)*(1+x/2),6) AS p FROM x""")
def chi_square_p(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("done"))
    out = s.with_p(s.chi_square(o, "o_orderpriority", "done"), "chi2")
    return out.select(F.round("chi2", 6).alias("chi2"), F.col("dof").cast("int").alias("dof"), F.round("p", 6).alias("p"))


@register("anova_p", """WITH g AS (SELECT s_nationkey%3 g, count(*) n, avg(s_acctbal) m, var_samp(s_acctbal)*(count(*)-1) w FROM supplier GROUP BY 1), t AS (SELECT sum(n)::DOUBLE n, sum(w) w, sum(n*m*m)-pow(sum(n*m),2)/sum(n) b FROM g)
SELECT round((b/2)/(w/(n-3)),6) AS f, round(pow(w/(w+b),(n-3)/2),6) AS p FROM t""")
def anova_p(spark, d):
    """With three groups the tail of F has a closed form."""
    out = s.with_p(s.anova(table(spark, d, "supplier").withColumn("g", F.col("s_nationkey") % 3), "g", "s_acctbal"), "anova")
    return rounded(out.select("f", "p"), 6)


@register("guarded_correlation", "SELECT count(*) AS n, round(corr(l_quantity,l_extendedprice),6) AS r FROM lineitem")
def guarded_correlation(spark, d):
    return rounded(i.guarded_correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 6)


@register("residual_summary", """WITH f AS (SELECT regr_slope(l_extendedprice,l_quantity) a, regr_intercept(l_extendedprice,l_quantity) b, regr_r2(l_extendedprice,l_quantity) r FROM lineitem), e AS (SELECT l_extendedprice-a*l_quantity-b e, a, b, r FROM lineitem, f)
SELECT round(any_value(a),4) AS slope, round(any_value(b),3) AS intercept, round(any_value(r),6) AS r_squared, round(avg(e),3)+0.0 AS residual_mean, round(stddev_pop(e),3) AS residual_std, round(min(e),3) AS residual_min, round(max(e),3) AS residual_max FROM e""")
def residual_summary(spark, d):
    out = i.residual_summary(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    places = {"slope": 4, "r_squared": 6}
    return out.select(*[(F.round(c, places.get(c, 3)) + 0.0).alias(c) for c in out.columns])


@register("mean_interval", f"""WITH RECURSIVE b AS (SELECT g, count(*) n, avg(v) m, stddev_samp(v)/sqrt(count(*)) e, 0.0::DOUBLE lo, 64.0::DOUBLE hi, 0 i FROM ({_S}) GROUP BY 1 UNION ALL
 SELECT g, n, m, e, CASE WHEN p>0.05 THEN x ELSE lo END, CASE WHEN p>0.05 THEN hi ELSE x END, i+1 FROM (SELECT *, {_t_p('x', '(n-1)')} p FROM (SELECT *, (lo+hi)/2 x FROM b WHERE i<45)))
SELECT g, n, round(m,4) AS mean, round(m-lo*e,4) AS low, round(m+lo*e,4) AS high FROM b WHERE i=45""")
def mean_interval(spark, d):
    return rounded(i.mean_interval(_urgent(spark, d), "s_acctbal", ["g"]))


_POISSON = "(" + "+".join(f"(u>={t!r})::INT" for t in [sum(__import__("math").exp(-1) / __import__("math").factorial(j) for j in range(k + 1)) for k in range(8)]) + ")"


@register("bootstrap_interval", f"""WITH b AS (SELECT unnest(range(1,51)) b), u AS (SELECT b, s_acctbal v, ('0x' || substr(md5(s_suppkey::VARCHAR || ':' || b::VARCHAR),1,8))::BIGINT/4294967296.0::DOUBLE u FROM supplier, b), m AS (SELECT b, sum({_POISSON}*v)/sum({_POISSON}) m FROM u GROUP BY 1)
SELECT round(quantile_cont(m,0.025),4) AS low, round(quantile_cont(m,0.975),4) AS high FROM m""")
def bootstrap_interval(spark, d):
    return rounded(i.bootstrap_interval(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 50))


@register("fisher_overlap", """WITH u AS (SELECT p_size>25 x, p_retailprice>1000 y FROM part), c AS (SELECT count(*) FILTER (WHERE x AND y) a, count(*) FILTER (WHERE x AND NOT y) b, count(*) FILTER (WHERE NOT x AND y) c, count(*) FILTER (WHERE NOT x AND NOT y) d FROM u)
SELECT a AS both, b AS first_only, c AS second_only, d AS neither, round(a*d/nullif(b*c,0),6) AS odds_ratio,
 round(list_sum(list_transform(range(a, least(a+b,a+c)+1), lambda k: exp(lgamma(a+b+1)-lgamma(k+1)-lgamma(a+b-k+1)+lgamma(c+d+1)-lgamma(a+c-k+1)-lgamma(d-a+k+1)-lgamma(a+b+c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)))),6) AS p FROM c""")
def fisher_overlap(spark, d):
    return rounded(i.fisher_greater(i.overlap_table(table(spark, d, "part"), "p_partkey", F.col("p_size") > 25, F.col("p_retailprice") > 1000), "both", "first_only", "second_only", "neither"), 6)


@register("distribution_fits", """WITH m AS (SELECT o_orderpriority k, count(*) n, avg(v) mu, var_pop(v) s2, avg(ln(v)) lmu, var_pop(ln(v)) ls2, sum(ln(v)) sl FROM (SELECT o_orderpriority, o_totalprice v FROM orders WHERE o_totalprice>0) GROUP BY 1),
 f AS (SELECT k prio, n AS n, unnest([{n:'norm',k:2,l:-n/2*(ln(2*pi()*s2)+1),a:mu,b:sqrt(s2)},{n:'lognorm',k:2,l:-n/2*(ln(2*pi()*ls2)+1)-sl,a:lmu,b:sqrt(ls2)},{n:'expon',k:1,l:-n*(ln(mu)+1),a:mu,b:NULL}]) z FROM m)
SELECT prio AS o_orderpriority, n, z.n AS distribution, round(z.l,3) AS log_likelihood, round(2*z.k-2*z.l,3) AS aic, round(z.a,3) AS location, round(z.b,3) AS scale FROM f""")
def distribution_fits(spark, d):
    return rounded(i.distribution_fits(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), 3)


@register("segmented_fit", """WITH b AS (SELECT unnest([10.0,20.0,30.0,40.0]) b), x AS (SELECT b, l_quantity>b r, regr_slope(l_extendedprice,l_quantity) s, regr_syy(l_extendedprice,l_quantity)*(1-regr_r2(l_extendedprice,l_quantity)) e FROM lineitem, b GROUP BY 1,2),
 w AS (SELECT b, sum(e) e, max(s) FILTER (WHERE NOT r) ls, max(s) FILTER (WHERE r) rs FROM x GROUP BY 1) SELECT b::DOUBLE AS at, round(e/1e6,1) AS sse, round(ls,2) AS left_slope, round(rs,2) AS right_slope FROM w ORDER BY e LIMIT 1""")
def segmented_fit(spark, d):
    out = i.segmented_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", [10, 20, 30, 40])
    return out.select("at", F.round(F.col("sse") / 1e6, 1).alias("sse"), F.round("left_slope", 2).alias("left_slope"), F.round("right_slope", 2).alias("right_slope"))


@register("effect_label", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount*10<0.2 THEN 'negligible' WHEN l_discount*10<0.5 THEN 'small' WHEN l_discount*10<0.8 THEN 'medium' ELSE 'large' END AS effect, CASE WHEN l_tax<0.001 THEN '***' WHEN l_tax<0.01 THEN '**' WHEN l_tax<0.05 THEN '*' ELSE 'ns' END AS stars FROM lineitem")
def effect_label(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", i.effect_label(F.col("l_discount") * 10).alias("effect"), s.stars(F.col("l_tax")).alias("stars"))


@register("assumption_warnings", """WITH m AS (SELECT event_type, count(value) n, avg(value) a, var_pop(value) s2, avg(value*value*value) c3, avg(value*value) c2, kurtosis_pop(value) k FROM events GROUP BY 1), j AS (SELECT event_type, n, n/6*(pow((c3-3*a*c2+2*a*a*a)/pow(s2,1.5),2)+k*k/4) jb FROM m)
SELECT event_type, n, round(jb,3) AS jarque_bera, concat_ws(';', CASE WHEN n<30 THEN 'few rows' END, CASE WHEN jb>5.991464547 THEN 'not normal' END) AS warnings FROM j""")
def assumption_warnings(spark, d):
    return rounded(i.assumption_warnings(table(spark, d, "events"), "event_type", "value"), 3)


@register("sample_sizes", """SELECT l_linenumber, round(avg(l_discount)*4,9) AS effect, ceil(2*pow(1.959963984540054+0.8416212335729143,2)/pow(round(avg(l_discount)*4,9),2))::BIGINT AS n_t,
 ceil(pow((1.959963984540054+0.8416212335729143)/(0.5*ln((1+round(avg(l_discount)*4,9))/(1-round(avg(l_discount)*4,9)))),2)+3)::BIGINT AS n_r FROM lineitem GROUP BY 1""")
def sample_sizes(spark, d):
    return i.sample_sizes(table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg("l_discount") * 4, 9).alias("effect")), "effect")


@register("test_power", f"WITH g AS (SELECT l_linenumber, avg(l_discount)*4 e, count(*)/200.0 n FROM lineitem GROUP BY 1), x AS (SELECT *, e*sqrt(n/2)-1.959963984540054 x FROM g) SELECT l_linenumber, round(CASE WHEN x>=0 THEN 1-({_z_p('x')})/2 ELSE ({_z_p('x')})/2 END,5) AS power FROM x")
def power(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_linenumber").agg((F.avg("l_discount") * 4).alias("e"), (F.count("*") / 200).alias("n"))
    return i.test_power(g, "e", "n").select("l_linenumber", F.round("power", 5).alias("power"))


@register("confidence_fold", """WITH l AS (SELECT o_custkey, list(struct_pack(o := o_orderkey, s := o_orderstatus='F', w := (o_orderkey%10)/10.0::DOUBLE) ORDER BY o_orderkey) x FROM orders GROUP BY 1)
SELECT o_custkey, len(x)::INT AS n, round(list_reduce(list_prepend(0.5::DOUBLE, list_transform(x, lambda e: CASE WHEN e.s THEN 10+e.w ELSE 20+e.w END)), lambda c, y: CASE WHEN y<20 THEN c+(1-c)*(y-10)*0.3 ELSE c*(1-(y-20)*0.3) END),7) AS confidence FROM l""")
def confidence_fold(spark, d):
    """To seven places: after n steps the value has 2 n + 1 digits, so none lies half-way."""
    o = table(spark, d, "orders").withColumn("w", (F.col("o_orderkey") % 10) / F.lit(10.0))
    return rounded(i.confidence_fold(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", "w"), 7)


@register("shuffled_columns", """WITH a AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) i FROM customer), b AS (SELECT c_acctbal, row_number() OVER (ORDER BY md5('7:c_acctbal:' || c_custkey::VARCHAR)) i FROM customer)
SELECT c_custkey, c_nationkey, c_acctbal FROM a JOIN b USING(i)""")
def shuffled_columns(spark, d):
    return i.shuffled(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey", ["c_acctbal"], "7")


@register("null_summary", f"""WITH b AS (SELECT unnest(range(1,101)) b), u AS (SELECT b, s_acctbal v, ('0x' || substr(md5(s_suppkey::VARCHAR || ':' || b::VARCHAR),1,8))::BIGINT/4294967296.0::DOUBLE u FROM supplier, b), m AS (SELECT b, sum({_POISSON}*v)/sum({_POISSON}) m FROM u GROUP BY 1)
SELECT count(*) AS draws, round(avg(m),4) AS mean, round(stddev_samp(m),4) AS std, round((count(*) FILTER (WHERE abs(m)>=4500)+1)/(count(*)+1),4) AS p, round(quantile_cont(m,0.05),4) AS q0, round(quantile_cont(m,0.5),4) AS q1, round(quantile_cont(m,0.95),4) AS q2 FROM m""")
def null_summary(spark, d):
    return rounded(i.null_summary(i.bootstrap_means(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", 100), "mean", F.lit(4500.0)))


_UNIT = "('0x' || substr(md5({x}),1,8))::BIGINT"


@register("group_split", f"SELECT c_custkey, CASE WHEN {_UNIT.format(x=chr(39) + 'split:' + chr(39) + ' || c_nationkey::VARCHAR')}/4294967296.0::DOUBLE < 0.3 THEN 'test' ELSE 'train' END AS split FROM customer")
def group_split(spark, d):
    return i.group_split(table(spark, d, "customer"), "c_nationkey", 0.3).select("c_custkey", "split")


@register("three_way_split", "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR))/count(*) OVER () a FROM orders) SELECT o_orderkey, CASE WHEN a<=0.2 THEN 'test' WHEN a<=0.2+0.1 THEN 'validation' ELSE 'train' END AS split FROM p")
def three_way_split(spark, d):
    return i.three_way_split(table(spark, d, "orders"), "o_orderkey", 0.2, 0.1).select("o_orderkey", "split")


_FOLD = f"({_UNIT.format(x='o_orderkey::VARCHAR')}%5)::INT"


@register("fold_scores", f"""WITH f AS (SELECT {_FOLD} f, (o_custkey%100)::DOUBLE x, o_totalprice y FROM orders), k AS (SELECT a.f, regr_slope(b.y,b.x) s, regr_intercept(b.y,b.x) i FROM (SELECT DISTINCT f FROM f) a JOIN f b ON a.f<>b.f GROUP BY 1)
SELECT f AS fold, count(*) AS n, round(any_value(s),3) AS slope, round(any_value(i),2) AS intercept, round(avg(pow(y-s*x-i,2))/1e6,1) AS mse FROM f JOIN k USING(f) GROUP BY 1""")
def fold_scores(spark, d):
    o = i.folds(table(spark, d, "orders").withColumn("x", F.col("o_custkey") % 100), "o_orderkey", 5)
    return i.fold_scores(o, "fold", "x", "o_totalprice").select("fold", "n", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round(F.col("mse") / 1e6, 1).alias("mse"))


@register("out_of_fold", f"""WITH f AS (SELECT o_orderkey, {_FOLD} f, (o_custkey%100)::DOUBLE x, o_totalprice y FROM orders), k AS (SELECT a.f, regr_slope(b.y,b.x) s, regr_intercept(b.y,b.x) i FROM (SELECT DISTINCT f FROM f) a JOIN f b ON a.f<>b.f GROUP BY 1)
SELECT o_orderkey, round(s*x+i,2) AS prediction FROM f JOIN k USING(f)""")
def out_of_fold(spark, d):
    o = i.folds(table(spark, d, "orders").withColumn("x", F.col("o_custkey") % 100), "o_orderkey", 5)
    return i.out_of_fold(o, "fold", "x", "o_totalprice").select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register("quota_sample", """WITH p AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR)) k FROM events), c AS (SELECT *, row_number() OVER (ORDER BY k, event_type) r FROM p WHERE k<=40 QUALIFY r<=150)
SELECT event_id, event_type, round(1.0/count(*) OVER (PARTITION BY event_type),9) AS weight FROM c""")
def quota_sample(spark, d):
    return rounded(i.quota_sample(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 40, 150), 9)


@register("first_per_group", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def first_per_group(spark, d):
    return i.first_per_group(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 3)


@register("row_digest", "WITH r AS (SELECT sha256(concat_ws('|', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)) r FROM nation ORDER BY 1 LIMIT 20000) SELECT sha256(string_agg(r, '' ORDER BY r)) AS digest, count(*) AS n FROM r")
def row_digest(spark, d):
    return i.digest(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@register("latin_design", """WITH n AS (SELECT count(*) n FROM supplier), x AS (SELECT s_suppkey k, row_number() OVER (ORDER BY md5('heat:' || s_suppkey::VARCHAR)) a, row_number() OVER (ORDER BY md5('time:' || s_suppkey::VARCHAR)) b FROM supplier)
SELECT k AS s_suppkey, round(20+(a-0.5)/n*80,6) AS heat, round((b-0.5)/n*10,6) AS time FROM x, n""")
def latin_design(spark, d):
    points = table(spark, d, "supplier").select("s_suppkey")
    return rounded(i.latin_design(points.count(), {"heat": (20.0, 100.0), "time": (0.0, 10.0)}, points, "s_suppkey"), 6)


@register("split_half", f"""WITH h AS (SELECT l_returnflag g, l_suppkey f, sum(CASE WHEN {_UNIT.format(x='l_orderkey::VARCHAR')}%2=0 THEN l_quantity ELSE 0 END) a, sum(CASE WHEN {_UNIT.format(x='l_orderkey::VARCHAR')}%2=1 THEN l_quantity ELSE 0 END) b FROM lineitem GROUP BY 1,2)
SELECT g AS l_returnflag, count(*) AS n_features, round(corr(a,b),5) AS reliability FROM h GROUP BY 1""")
def split_half(spark, d):
    return rounded(i.split_half(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_suppkey", "l_quantity"), 5)


@register("control_pairs", """WITH p AS (SELECT c_nationkey g, c_custkey c, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR))-1 k, count(*) OVER (PARTITION BY c_nationkey) n FROM customer WHERE c_mktsegment='BUILDING'),
 r AS (SELECT c_nationkey g, c_custkey i, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR))-1 k FROM customer WHERE c_mktsegment<>'BUILDING')
SELECT r.i AS c_custkey, r.g AS c_nationkey, p.c AS control_id FROM r JOIN (SELECT DISTINCT g, n FROM p) z USING(g) JOIN p ON p.g=r.g AND p.k=r.k%z.n""")
def control_pairs(spark, d):
    return i.control_pairs(table(spark, d, "customer"), "c_custkey", "c_nationkey", F.col("c_mktsegment") == "BUILDING")
