"""Matching keys of two tables, and rows needed for effects that the tables show."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import partners as p
from spectrafold.operators import power as w
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table

c = F.col

_PAIRS = """a AS (SELECT DISTINCT k, regexp_replace(trim(v),'[-.][0-9]+$','') v FROM (SELECT 'c_custkey' k, c_custkey::VARCHAR v FROM customer UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)),
 b AS (SELECT DISTINCT k, regexp_replace(trim(v),'[-.][0-9]+$','') v FROM (SELECT 'o_orderkey' k, o_orderkey::VARCHAR || '-1' v FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)),
 m AS (SELECT a.k l, b.k r, count(*) s FROM a JOIN b USING(v) GROUP BY 1,2), o AS (SELECT l AS left_key, r AS right_key, (SELECT count(*) FROM a WHERE k=l) AS n_left, (SELECT count(*) FROM b WHERE k=r) AS n_right, s AS shared FROM m)"""


def _halves(spark, d):
    return table(spark, d, "customer"), table(spark, d, "orders").withColumn("o_orderkey", F.concat(c("o_orderkey").cast("string"), F.lit("-1")))


@register("key_pairs", f"WITH {_PAIRS} SELECT *, round(shared/least(n_left,n_right),6) AS fraction FROM o")
def key_pairs(spark, d):
    return rounded(p.key_pairs(*_halves(spark, d)), 6)


@register("best_key_pair", f"WITH {_PAIRS} SELECT *, round(shared/least(n_left,n_right),6) AS fraction FROM o WHERE right_key='o_custkey' ORDER BY round(shared/least(n_left,n_right),6) DESC, shared DESC, left_key LIMIT 1")
def best_key_pair(spark, d):
    """For the orders' customers."""
    return rounded(p.best_key_pair(*_halves(spark, d), ["o_custkey"]), 6)


@register("rows_for_effects")
def rows_for_effects(spark, d):
    """Rows for the effect of each line number's return flag on the quantity, whose eta squared gives f; SQL lacks the noncentral distribution, see tests/test_partners.py."""
    line = table(spark, d, "lineitem").select("l_linenumber", "l_returnflag", (c("l_quantity") + F.when(c("l_returnflag") == "R", c("l_linenumber")).otherwise(0)).alias("v"))
    groups = line.groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    total = groups.groupBy("l_linenumber").agg(F.count("*").alias("k"), (F.sum(c("n") * c("m")) / F.sum("n")).alias("g"), F.sum(c("n") * c("s")).alias("within"), F.sum(c("n") * c("m") * c("m")).alias("q"), F.sum("n").alias("n"))
    effects = total.select("l_linenumber", "k", F.sqrt((c("q") - c("n") * c("g") * c("g")) / c("within")).alias("f"))
    told = w.anova_rows(effects, "f", "k")
    told = w.regression_rows(told.withColumn("f2", c("f") * c("f")).withColumn("p", c("k") - 1), "f2", "p").withColumnRenamed("n_rows", "n_regression")
    return w.chi2_rows(told, "f", "p").withColumnRenamed("n_rows", "n_chi2").select("l_linenumber", "k", F.round("f", 6).alias("f"), "n_per_group", "n_regression", "n_chi2")
