"""Labels, splits and responses of perturbation screens, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import screens as s
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table

c = F.col

#: Parts as conditions: two words as genes, one word, a placeholder beside a word, guides and controls.
_CONDITION = """CASE p_size%7 WHEN 0 THEN replace(p_name,' ','+') WHEN 1 THEN replace(p_name,' ','_') WHEN 2 THEN split_part(p_name,' ',1) || '+ctrl' WHEN 3 THEN split_part(p_name,' ',2) || 'g' || p_size WHEN 4 THEN 'NTg' || p_size WHEN 5 THEN ' Ctrl ' ELSE split_part(p_name,' ',1) END"""


def _conditions(spark, d):
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    size, rest = c("p_size").cast("string"), c("p_size") % 7
    said = F.when(rest == 0, F.replace("p_name", F.lit(" "), F.lit("+"))).when(rest == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(rest == 2, F.concat(word(1), F.lit("+ctrl")))
    said = said.when(rest == 3, F.concat(word(2), F.lit("g"), size)).when(rest == 4, F.concat(F.lit("NTg"), size)).when(rest == 5, F.lit(" Ctrl ")).otherwise(word(1))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size", said.alias("condition"))


@register("condition_labels", f"""WITH x AS (SELECT p_partkey, trim({_CONDITION}) t FROM part), g AS (SELECT *, CASE WHEN contains(t,'+') THEN string_split(t,'+') WHEN contains(t,'_') THEN string_split(t,'_') ELSE [t] END g FROM x)
SELECT p_partkey, array_to_string(CASE WHEN len(g)>1 THEN list_filter(g, lambda v: lower(v)<>'ctrl') ELSE g END,',') AS genes, lower(t)='ctrl' OR regexp_matches(lower(t),'^nt[a-z]?[0-9]+$') AS control FROM g""")
def condition_labels(spark, d):
    return _conditions(spark, d).select("p_partkey", F.array_join(s.condition_genes(c("condition")), ",").alias("genes"), s.is_control(c("condition")).alias("control"))


@register("perturbed_genes", f"""WITH x AS (SELECT p_partkey, trim({_CONDITION}) t FROM part), k AS (SELECT DISTINCT split_part(p_name,' ',2) g FROM part WHERE p_size>10 UNION SELECT DISTINCT 'ringg' || p_size FROM part WHERE p_size<20)
SELECT p_partkey, CASE WHEN t NOT IN (SELECT g FROM k) AND regexp_extract(t,'^(.+?)[-_.]?g[0-9]+$',1) IN (SELECT g FROM k) THEN regexp_extract(t,'^(.+?)[-_.]?g[0-9]+$',1) ELSE t END AS perturbed FROM x""")
def perturbed_genes(spark, d):
    """Known are second words of the parts' names, and some guides that are names themselves."""
    part = table(spark, d, "part")
    known = part.where("p_size > 10").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("g")).union(part.where("p_size < 20").select(F.concat(F.lit("ringg"), c("p_size").cast("string"))))
    return s.perturbed_genes(_conditions(spark, d), "condition", known, "g").select("p_partkey", "perturbed")


@register("identity_split", f"""WITH x AS (SELECT DISTINCT trim({_CONDITION}) t FROM part), y AS (SELECT t, md5('7:' || t) h, CASE WHEN t='red' THEN 'forced' WHEN (contains(t,'+') AND NOT contains(t,'+ctrl')) OR contains(t,'_') THEN 'several' ELSE 'one' END p FROM x WHERE NOT (lower(t)='ctrl' OR regexp_matches(lower(t),'^nt[a-z]?[0-9]+$'))),
 z AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY h) k, count(*) OVER (PARTITION BY p) n FROM y), w AS (SELECT *, CASE WHEN p='forced' THEN n ELSE round_even(n*0.2,0) END e FROM z)
SELECT t AS condition, CASE WHEN k<=e THEN 'test' WHEN k<=e+round_even((n-e)*0.1,0) THEN 'validation' ELSE 'train' END AS split FROM w""")
def identity_split(spark, d):
    return s.identity_split(_conditions(spark, d), "condition", "mixed", seed="7", holdout=["red"])


def _cells(spark, d):
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("sample"), c("l_partkey").alias("gene"), c("l_quantity").alias("value"))


_CPM = "x AS (SELECT l_suppkey s, l_partkey g, sum(l_quantity) v FROM lineitem GROUP BY 1,2), t AS (SELECT s, sum(v) t FROM x GROUP BY 1), m AS (SELECT g, sum(ln(1+v/t*10000))/(SELECT count(*) FROM supplier) m FROM x JOIN t USING(s) GROUP BY 1)"


@register("mean_log_cpm", f"WITH {_CPM} SELECT g AS gene, round(m,8) AS mean FROM m")
def mean_log_cpm(spark, d):
    return rounded(s.mean_log_cpm(_cells(spark, d), table(spark, d, "supplier").count()), 8)


@register("profile_similarity", f"""WITH {_CPM}, r AS (SELECT p_partkey g, ln(1+p_retailprice)/8 a FROM part WHERE p_partkey%3<>0), b AS (SELECT a, m b FROM r JOIN m USING(g) WHERE a>0.1), k AS (SELECT rank() OVER (ORDER BY a)+(count(*) OVER (PARTITION BY a)-1)/2.0 x, rank() OVER (ORDER BY b)+(count(*) OVER (PARTITION BY b)-1)/2.0 y FROM b)
SELECT (SELECT count(*) FROM b) AS shared_genes, round((SELECT corr(a,b) FROM b),6) AS pearson, round((SELECT corr(x,y) FROM k),6) AS spearman, (SELECT quantile_cont(t,0.5) FROM t) AS median_total, (SELECT quantile_cont(n,0.5) FROM (SELECT count(*)::DOUBLE n FROM x GROUP BY s)) AS median_genes, 0.0::DOUBLE AS ribosomal_share""")
def profile_similarity(spark, d):
    reference = table(spark, d, "part").where("p_partkey % 3 <> 0").select(c("p_partkey").alias("gene"), (F.log1p("p_retailprice") / 8).alias("mean"))
    return rounded(s.profile_similarity(reference, _cells(spark, d), table(spark, d, "supplier").count()), 6)


@register("count_matrix_verdict", """WITH x AS (SELECT sum(l_quantity) v FROM lineitem GROUP BY l_suppkey, l_partkey), n AS (SELECT (SELECT count(*) FROM supplier)*(SELECT count(*) FROM part) n), m AS (SELECT count(*) c, min(v) lo, count(*) FILTER (WHERE v=floor(v)) w FROM x)
SELECT CASE WHEN (SELECT count(*) FROM part)<500 THEN 'too few columns' WHEN lo<0 THEN 'negative values' WHEN (n-c)/n<0.5 THEN 'too few zeros' WHEN (w+n-c)/n<0.99 THEN 'not whole numbers' ELSE 'counts' END AS reason, round((n-c)/n,8) AS zeros, round((w+n-c)/n,8) AS whole FROM m, n""")
def count_matrix_verdict(spark, d):
    summed = _cells(spark, d).groupBy("sample", "gene").agg(F.sum("value").alias("value"))
    return rounded(s.count_matrix_verdict(summed, table(spark, d, "supplier").count(), table(spark, d, "part").count()).select("reason", "zeros", "whole"), 8)


def _responses(spark, d):
    """Of suppliers' nations (labels) and brands (genes): quantity and discount against their means."""
    sold = table(spark, d, "lineitem").join(table(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey")).join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    m = sold.groupBy(c("s_nationkey").alias("label"), c("p_brand").alias("gene")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("x"))
    predicted, observed = ((F.round(c(n) - k, 6)).alias("value") for n, k in (("x", 0.05), ("q", 25.5)))
    return m.where("label <> 3").select("label", "gene", predicted), m.where("label <> 5").select("label", "gene", observed)


_RESPONSES = """m AS (SELECT s_nationkey label, p_brand gene, round(avg(l_discount)-0.05,6) p, round(avg(l_quantity)-25.5,6) o FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey GROUP BY 1,2),
 b AS (SELECT label, gene, p, o FROM m WHERE label NOT IN (3,5))"""


@register("response_metrics", f"""WITH {_RESPONSES}, n AS (SELECT count(DISTINCT label) n FROM b), g AS (SELECT gene, sum(p)/any_value(n) pm, sum(o)/any_value(n) om FROM b, n GROUP BY 1),
 r AS (SELECT b.*, pm, om, row_number() OVER (PARTITION BY label ORDER BY abs(o) DESC, gene)<=8 d, row_number() OVER (PARTITION BY label ORDER BY abs(p) DESC, gene)<=8 k, rank() OVER (PARTITION BY label ORDER BY p)+(count(*) OVER (PARTITION BY label, p)-1)/2.0 rp, rank() OVER (PARTITION BY label ORDER BY o)+(count(*) OVER (PARTITION BY label, o)-1)/2.0 ro FROM b JOIN g USING(gene))
SELECT label, round(avg((p-o)*(p-o)),6) AS mse, round(avg((p-o)*(p-o)) FILTER (WHERE d),6) AS mse_deg, round(corr(p,o),6) AS pearson, round(corr(p,o) FILTER (WHERE d),6) AS pearson_deg, round(corr(p-pm,o-om),6) AS pearson_specific, round(corr(rp,ro),6) AS spearman,
 round(avg((sign(p)=sign(o))::INT) FILTER (WHERE d),6) AS direction_accuracy, round(count(*) FILTER (WHERE d AND k)/count(*) FILTER (WHERE d),6) AS top_overlap, count(*) FILTER (WHERE d) AS n_deg FROM r GROUP BY 1""")
def response_metrics(spark, d):
    return rounded(s.response_metrics(*_responses(spark, d), 8), 6)


@register("response_signal", f"""WITH {_RESPONSES}, n AS (SELECT count(DISTINCT label)::DOUBLE n FROM b), g AS (SELECT gene, sqrt(greatest(0,sum(p*p)/any_value(n)-pow(sum(p)/any_value(n),2))) p, sqrt(greatest(0,sum(o*o)/any_value(n)-pow(sum(o)/any_value(n),2))) o FROM b, n GROUP BY 1)
SELECT round(avg(p),8) AS across, round(avg(o),8) AS observed_across, round(avg(p)/avg(o),8) AS signal FROM g""")
def response_signal(spark, d):
    return rounded(s.response_signal(*_responses(spark, d)), 8)


@register("reference_responses", f"""WITH {_RESPONSES}, q AS (SELECT * FROM m WHERE label<>5), n AS (SELECT count(DISTINCT label)-1 n FROM q), t AS (SELECT label, gene, (sum(o) OVER (PARTITION BY gene)-o)/n v FROM q, n)
SELECT label, gene, round(v,6)+0.0 AS value FROM t""")
def reference_responses(spark, d):
    told = s.reference_responses(_responses(spark, d)[1]).where("reference = 'mean of the others'")
    return told.select("label", "gene", (F.round("value", 6) + 0.0).alias("value"))
