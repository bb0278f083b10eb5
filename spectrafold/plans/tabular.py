"""Cleaning, description and tests over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import cleaning as c
from spectrafold.operators import statistics as s
from spectrafold.registry import register
from spectrafold.session import table


def rounded(df, places=4):
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(n, places).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


_DESCRIBE = """
SELECT {by} count(v) AS n, count(*) - count(v) AS n_missing, round(avg(v),4) AS mean, round(stddev_samp(v),4) AS std, round(var_samp(v),4) AS variance,
 round(min(v),4) AS min, round(max(v),4) AS max,
 round((avg(v*v*v) - 3*avg(v)*avg(v*v) + 2*avg(v)**3) / pow(var_pop(v), 1.5), 4) AS skewness, round(kurtosis_pop(v),4) AS kurtosis,
 round(quantile_cont(v,0.05),4) AS p5, round(quantile_cont(v,0.1),4) AS p10, round(quantile_cont(v,0.25),4) AS q1, round(quantile_cont(v,0.5),4) AS median,
 round(quantile_cont(v,0.75),4) AS q3, round(quantile_cont(v,0.9),4) AS p90, round(quantile_cont(v,0.95),4) AS p95,
 round(max(v)-min(v),4) AS range, round(quantile_cont(v,0.75)-quantile_cont(v,0.25),4) AS iqr, round(stddev_samp(v)/abs(avg(v)),4) AS cv
FROM ({source}) {group}"""


@register("describe_lineitem", _DESCRIBE.format(by="l_returnflag,", source="SELECT l_returnflag, l_quantity AS v FROM lineitem", group="GROUP BY l_returnflag"))
def describe_lineitem(spark, d):
    return rounded(s.describe(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]))


@register("describe_events", _DESCRIBE.format(by="event_type,", source="SELECT event_type, value AS v FROM events", group="GROUP BY event_type"))
def describe_events(spark, d):
    return rounded(s.describe(table(spark, d, "events"), "value", ["event_type"]))


@register("remove_missing", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL")
def remove_missing(spark, d):
    return c.remove_missing(table(spark, d, "orders"), ["o_orderpriority", "o_custkey"]).select("o_orderkey", "o_orderpriority")


@register("filter_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_nationkey > 0")
def filter_positive(spark, d):
    return c.filter_positive(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"]).select("c_custkey", "c_acctbal")


@register("outliers_iqr", """WITH f AS (SELECT quantile_cont(l_extendedprice,0.25) a, quantile_cont(l_extendedprice,0.75) b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, f WHERE l_extendedprice BETWEEN a-1.5*(b-a) AND b+1.5*(b-a)""")
def outliers_iqr(spark, d):
    return c.remove_outliers(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")


@register("outliers_zscore", """WITH f AS (SELECT avg(o_totalprice) m, stddev_pop(o_totalprice) s FROM orders)
SELECT o_orderkey, o_totalprice FROM orders, f WHERE abs((o_totalprice-m)/s) < 1.5""")
def outliers_zscore(spark, d):
    return c.remove_outliers(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "zscore")


@register("normalize_zscore", "SELECT s_suppkey, round((s_acctbal-avg(s_acctbal) OVER ())/stddev_samp(s_acctbal) OVER (),6) AS s_acctbal FROM supplier")
def normalize_zscore(spark, d):
    return rounded(c.normalize(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"]), 6)


@register("normalize_minmax", "SELECT p_partkey, round((p_retailprice-min(p_retailprice) OVER ())/(max(p_retailprice) OVER ()-min(p_retailprice) OVER ()),6) AS p_retailprice FROM part")
def normalize_minmax(spark, d):
    return rounded(c.normalize(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "minmax"), 6)


@register("tidy_names", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_type || ' / ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def tidy_names(spark, d):
    return table(spark, d, "part").select("p_partkey", c.tidy_name(F.concat_ws(" / ", "p_type", "p_brand")).alias("name"))


@register("numeric_text", """SELECT event_id, CASE WHEN lower(trim(x)) NOT IN ('','?','na','n/a','nan','none','null') THEN try_cast(trim(x) AS DOUBLE) END AS number
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' NA ' WHEN 1 THEN '?' ELSE regexp_extract(props, '[0-9]+') END x FROM events)""")
def numeric_text(spark, d):
    said = F.when(F.col("event_id") % 4 == 0, " NA ").when(F.col("event_id") % 4 == 1, "?").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    return table(spark, d, "events").select("event_id", c.parse_numeric_text(said).alias("number"))


@register("t_test", """WITH m AS (SELECT count(*) FILTER (WHERE l_returnflag='A') n1, count(*) FILTER (WHERE l_returnflag='R') n2,
 avg(l_extendedprice) FILTER (WHERE l_returnflag='A') m1, avg(l_extendedprice) FILTER (WHERE l_returnflag='R') m2,
 var_samp(l_extendedprice) FILTER (WHERE l_returnflag='A') v1, var_samp(l_extendedprice) FILTER (WHERE l_returnflag='R') v2 FROM lineitem),
 p AS (SELECT *, ((n1-1)*v1+(n2-1)*v2)/(n1+n2-2) sp FROM m)
SELECT n1, n2, round(m1,4) AS mean1, round(m2,4) AS mean2, round((m1-m2)/sqrt(sp*(1.0/n1+1.0/n2)),4) AS t, n1+n2-2 AS df, round((m1-m2)/sqrt(sp),4) AS cohens_d, round(log2(m1/m2),4) AS log2_fold_change FROM p""")
def t_test(spark, d):
    return rounded(s.t_test(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R"))


@register("anova", """WITH g AS (SELECT o_orderpriority, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) s2 FROM orders GROUP BY 1),
 t AS (SELECT sum(n) total, count(*) k, sum(n*m)/sum(n) grand, sum((n-1)*s2) ss_within FROM g),
 b AS (SELECT sum(n*(m-grand)**2) between_ss FROM g, t)
SELECT k, total::BIGINT AS total, round((between_ss/(k-1))/(ss_within/(total-k)),4) AS f, k-1 AS df_between, (total-k)::BIGINT AS df_within, round(between_ss/(between_ss+ss_within),6) AS eta_squared FROM t, b""")
def anova(spark, d):
    out = s.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return out.withColumn("f", F.round("f", 4)).withColumn("eta_squared", F.round("eta_squared", 6))


@register("linear_fit", """SELECT l_returnflag, count(*) AS n, round(corr(l_extendedprice,l_quantity),6) AS r, round(regr_slope(l_extendedprice,l_quantity),4) AS slope,
 round(regr_intercept(l_extendedprice,l_quantity),4) AS intercept, round(corr(l_extendedprice,l_quantity)**2,6) AS r_squared,
 round(sqrt(var_pop(l_extendedprice)*(1-corr(l_extendedprice,l_quantity)**2)/var_pop(l_quantity)/(count(*)-2)),4) AS std_err FROM lineitem GROUP BY 1""")
def linear_fit(spark, d):
    out = s.linear_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(out.withColumns({x: F.round(x, 6) for x in ("r", "r_squared")}), 6).withColumns({x: F.round(x, 4) for x in ("slope", "intercept", "std_err")})


@register("power_law", """WITH g AS (SELECT log10(l_quantity) x, log10(l_extendedprice) y FROM lineitem WHERE l_quantity>0 AND l_extendedprice>0)
SELECT count(*) AS n, round(corr(x,y),4) AS r, round(regr_slope(y,x),4) AS exponent, round(corr(x,y)**2,4) AS r_squared,
 round(sqrt(var_pop(y)*(1-corr(x,y)**2)/var_pop(x)/(count(*)-2)),4) AS std_err, round(pow(10,regr_intercept(y,x)),4) AS factor FROM g""")
def power_law(spark, d):
    return rounded(s.power_law(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@register("mann_whitney", """WITH b AS (SELECT l_returnflag g, l_quantity v FROM lineitem WHERE l_returnflag IN ('A','N')),
 r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0 mr, count(*) OVER (PARTITION BY v) t FROM b),
 m AS (SELECT count(*) FILTER (WHERE g='A') n1, count(*) FILTER (WHERE g='N') n2, (sum(mr) FILTER (WHERE g='A'))::DOUBLE r1, sum(t*t-1)::DOUBLE tied FROM r)
SELECT n1, n2, r1-n1*(n1+1)/2.0::DOUBLE AS u, round((r1-n1*(n1+1)/2.0::DOUBLE-n1*n2/2.0::DOUBLE)/sqrt(n1*n2/12.0::DOUBLE*((n1+n2+1)-tied/((n1+n2)*(n1+n2-1)::DOUBLE))),4) AS z FROM m""")
def mann_whitney(spark, d):
    return s.mann_whitney(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "A", "N").withColumn("z", F.round("z", 4))


_CHI = """WITH o AS ({cells}), r AS (SELECT a, sum(o) nr FROM o GROUP BY a), c AS (SELECT b, sum(o) nc FROM o GROUP BY b), t AS (SELECT sum(o) n FROM o),
 e AS (SELECT coalesce(o.o,0) o, nr*nc/n::DOUBLE e FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.a=r.a AND o.b=c.b),
 k AS (SELECT (SELECT count(*) FROM r) k, (SELECT count(*) FROM c) m)
SELECT round(sum(pow(abs(o-e){fix},2)/e),4) AS chi2, any_value((k-1)*(m-1)) AS dof, any_value(n)::BIGINT AS n, round(sqrt(sum(pow(abs(o-e){fix},2)/e)/any_value(n*(least(k,m)-1))),6) AS cramers_v FROM e, k, t"""


@register("chi_square", _CHI.format(cells="SELECT l_returnflag a, l_linestatus b, count(*) o FROM lineitem GROUP BY 1,2", fix=""))
def chi_square(spark, d):
    return s.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumns({"chi2": F.round("chi2", 4), "cramers_v": F.round("cramers_v", 6)})


@register("chi_square_yates", _CHI.format(cells="SELECT l_linestatus a, (l_quantity > 25)::INT b, count(*) o FROM lineitem GROUP BY 1,2", fix="-least(0.5,abs(o-e))"))
def chi_square_yates(spark, d):
    df = table(spark, d, "lineitem").select("l_linestatus", (F.col("l_quantity") > 25).cast("int").alias("large"))
    return s.chi_square(df, "l_linestatus", "large").withColumns({"chi2": F.round("chi2", 4), "cramers_v": F.round("cramers_v", 6)})


def _p_values(spark, d):
    """One made p-value per supplier from its sales, as corrections take any family of tests."""
    sold = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"))
    return sold.select("l_suppkey", F.round(F.exp(-F.abs(F.col("m") - 0.05) * F.sqrt("n") * 60), 9).alias("p"))


_P = "SELECT l_suppkey, round(exp(-abs(avg(l_discount)-0.05)*sqrt(count(*))*60),9) p FROM lineitem GROUP BY 1"


@register("bonferroni", f"WITH p AS ({_P}) SELECT l_suppkey, p, count(*) OVER () AS m, round(least(p*count(*) OVER (),1.0),6) AS adjusted, p < 0.05/count(*) OVER () AS significant FROM p")
def bonferroni(spark, d):
    return s.bonferroni(_p_values(spark, d)).withColumn("adjusted", F.round("adjusted", 6))


@register("benjamini_hochberg", f"""WITH p AS ({_P}), r AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS rank, count(*) OVER () AS m FROM p)
SELECT p, rank::INT AS rank, m, round(least(p*m/rank,1.0),6) AS adjusted, rank <= coalesce((SELECT max(rank) FROM r WHERE p <= 0.05*rank/m),0) AS significant FROM r""")
def benjamini_hochberg(spark, d):
    return s.benjamini_hochberg(_p_values(spark, d)).select("p", "rank", "m", F.round("adjusted", 6).alias("adjusted"), "significant")


@register("benjamini_hochberg_monotone", f"""WITH p AS ({_P}), r AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS rank, count(*) OVER () AS m FROM p)
SELECT p, rank::INT AS rank, round(min(least(p*m/rank,1.0)) OVER (ORDER BY rank DESC),6) AS adjusted FROM r""")
def benjamini_hochberg_monotone(spark, d):
    return s.benjamini_hochberg(_p_values(spark, d), monotone=True).select("p", "rank", F.round("adjusted", 6).alias("adjusted"))


@register("holm", f"""WITH p AS ({_P}), r AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS rank, count(*) OVER () AS m FROM p)
SELECT p, rank::INT AS rank, m, round(max(least(p*(m-rank+1),1.0)) OVER (ORDER BY rank),6) AS adjusted, rank < coalesce((SELECT min(rank) FROM r WHERE p > 0.05/(m-rank+1)), m+1) AS significant FROM r""")
def holm(spark, d):
    return s.holm(_p_values(spark, d)).select("p", "rank", "m", F.round("adjusted", 6).alias("adjusted"), "significant")
