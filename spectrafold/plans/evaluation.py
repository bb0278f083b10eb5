"""Per-gene tests and metrics of predictions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import evaluation as e
from spectrafold.operators import expression as x
from spectrafold.plans.inference import _t_p
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table

_SAMPLES = "SELECT s_suppkey, CASE WHEN s_nationkey%3=0 THEN 'case' WHEN s_nationkey%3=1 THEN 'control' ELSE 'other' END k FROM supplier"
#: Every gene of every sample, zeros made explicit, which the operator avoids.
_DE = f"""WITH s AS ({_SAMPLES}), c AS (SELECT l_partkey, l_suppkey, sum(l_quantity) x FROM lineitem GROUP BY 1,2), g AS (SELECT l_partkey FROM c GROUP BY 1 HAVING sum(x) >= 200),
 d AS (SELECT g.l_partkey, s.k, coalesce(c.x, 0) x, log2(coalesce(c.x, 0)+1) y FROM g, s LEFT JOIN c ON c.l_partkey=g.l_partkey AND c.l_suppkey=s.s_suppkey WHERE s.k<>'other'),
 m AS (SELECT l_partkey, avg(x) base_mean, count(*) FILTER (WHERE k='case') a, count(*) FILTER (WHERE k='control') b, avg(y) FILTER (WHERE k='case') - avg(y) FILTER (WHERE k='control') f, (var_samp(y) FILTER (WHERE k='case')*(a-1) + var_samp(y) FILTER (WHERE k='control')*(b-1))/(a+b-2) v FROM d GROUP BY 1),
 t AS (SELECT *, f/sqrt(v*(1.0/a+1.0/b)) t, a+b-2 df FROM m), p AS (SELECT *, {_t_p('t', 'df')} p FROM t),
 r AS (SELECT *, p*(count(*) OVER ())/row_number() OVER (ORDER BY p) raw, row_number() OVER (ORDER BY p) k FROM p), q AS (SELECT *, least(1, min(raw) OVER (ORDER BY k DESC)) q FROM r)"""


def _expression(spark, d):
    group = F.when(F.col("s_nationkey") % 3 == 0, "case").when(F.col("s_nationkey") % 3 == 1, "control").otherwise("other")
    samples = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), group.alias("k"))
    return x.differential_expression(table(spark, d, "lineitem"), samples, "l_suppkey", "l_partkey", "l_quantity", "k", "case", "control", 200)


@register("differential_expression", f"""{_DE} SELECT l_partkey AS gene, round(base_mean,6) AS base_mean, round(f,6) AS log2_fold_change, round(t,6) AS t, round(p,6) AS p, round(q,6) AS adjusted, q<0.05 AS significant, CASE WHEN q<0.05 THEN CASE WHEN f>0 THEN 'up' ELSE 'down' END ELSE 'unchanged' END AS direction FROM q""")
def differential_expression(spark, d):
    return rounded(_expression(spark, d), 6)


@register("expression_summary", f"""{_DE} SELECT count(*) AS n_tested, count(*) FILTER (WHERE q<0.05) AS n_significant, count(*) FILTER (WHERE q<0.05 AND f>0) AS n_up, count(*) FILTER (WHERE q<0.05 AND f<0) AS n_down FROM q""")
def expression_summary(spark, d):
    return x.expression_summary(_expression(spark, d))


_AREAS = """c AS (SELECT g, s, count(*) FILTER (WHERE y)::DOUBLE pos, count(*) FILTER (WHERE NOT y)::DOUBLE neg FROM {rows} GROUP BY 1,2),
 r AS (SELECT *, sum(pos) OVER w tp, sum(neg) OVER w fp, sum(pos) OVER (PARTITION BY g) P, sum(neg) OVER (PARTITION BY g) N FROM c WINDOW w AS (PARTITION BY g ORDER BY s DESC)),
 a AS (SELECT g, max(P) P, max(N) N, CASE WHEN max(P)>0 AND max(N)>0 THEN sum(neg*(tp-pos/2))/(max(P)*max(N)) END auroc, CASE WHEN max(P)>0 AND max(N)>0 THEN sum(pos*tp/(tp+fp))/max(P) END auprc FROM r GROUP BY 1)"""


@register("ranking_metrics", f"""WITH x AS (SELECT l_shipmode_g g, y, s FROM (SELECT l_linenumber l_shipmode_g, l_returnflag='R' AND l_linenumber<>3 y, l_quantity + l_discount*100 s FROM lineitem)), {_AREAS.format(rows='x')}
SELECT g AS l_linenumber, P::BIGINT AS n_positive, N::BIGINT AS n_negative, round(auroc,9) AS auroc, round(auprc,9) AS auprc FROM a""")
def ranking_metrics(spark, d):
    """Line number 3 has no positives, so its areas are null; scores tie often."""
    lines = table(spark, d, "lineitem")
    return rounded(e.ranking_metrics(lines, (F.col("l_returnflag") == "R") & (F.col("l_linenumber") != 3), F.col("l_quantity") + F.col("l_discount") * 100, ["l_linenumber"]), 9)


_S = "SELECT l_returnflag y, l_discount a, l_tax n, 0.04::DOUBLE r FROM lineitem"


@register("probability_metrics", f"""WITH z AS ({_S}), w AS (SELECT y, CASE WHEN a>=n AND a>=r THEN 'A' WHEN n>=r THEN 'N' ELSE 'R' END p FROM z),
 k AS (SELECT k, count(*) FILTER (WHERE y=k)::DOUBLE t, count(*) FILTER (WHERE p=k) q, count(*) FILTER (WHERE y=k AND p=k) h FROM w, (VALUES ('A'),('N'),('R')) v(k) GROUP BY 1),
 x AS (SELECT 'A' g, y='A' y, a s FROM z UNION ALL SELECT 'N', y='N', n FROM z UNION ALL SELECT 'R', y='R', r FROM z), {_AREAS.format(rows='x')}
SELECT sum(t)::BIGINT AS n, round(sum(h)/sum(t),9) AS accuracy, round(avg(h/t),9) AS balanced_accuracy, round(avg(2*h/(t+q)),9) AS macro_f1, (SELECT round(avg(auroc),9) FROM a) AS macro_auroc, (SELECT round(avg(auprc),9) FROM a) AS macro_auprc, 0 AS n_undefined FROM k""")
def probability_metrics(spark, d):
    told = e.probability_metrics(table(spark, d, "lineitem"), "l_returnflag", {"A": F.col("l_discount"), "N": F.col("l_tax"), "R": F.lit(0.04)})
    return rounded(told.withColumn("n_undefined", F.size("undefined")).drop("undefined"), 9)


@register("classification_summary", """WITH w AS (SELECT l_returnflag y, CASE WHEN l_discount>=0.05 THEN 'A' WHEN l_tax>=0.04 THEN 'N' ELSE 'R' END p FROM lineitem),
 k AS (SELECT k, count(*) FILTER (WHERE y=k)::DOUBLE t, count(*) FILTER (WHERE p=k) q, count(*) FILTER (WHERE y=k AND p=k) h FROM w, (VALUES ('A'),('N'),('R')) v(k) GROUP BY 1)
SELECT sum(t)::BIGINT AS n, count(*) AS n_classes, round(sum(h)/sum(t),9) AS accuracy, round(avg(h/t),9) AS balanced_accuracy, round(sum(h/q*t)/sum(t),9) AS precision, round(sum(h)/sum(t),9) AS recall, round(sum(2*h/(t+q)*t)/sum(t),9) AS f1 FROM k""")
def classification_summary(spark, d):
    said = F.when(F.col("l_discount") >= 0.05, "A").when(F.col("l_tax") >= 0.04, "N").otherwise("R")
    return rounded(e.classification_summary(table(spark, d, "lineitem").withColumn("said", said), "l_returnflag", "said", "binary"), 9)
