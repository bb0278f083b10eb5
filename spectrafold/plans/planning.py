"""Plans over the driver's tables, seen without the prefix of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import planning as p
from spectrafold.registry import register
from spectrafold.session import table

_TABLES = {"customer": "c_", "supplier": "s_", "nation": "n_", "part": "p_", "orders": "o_"}


def _tables(spark, d):
    """The tables with plain columns, the customers once more as a mirror, and the suppliers' accounts under other names."""
    out = {t: (df := table(spark, d, t)).toDF(*[c.removeprefix(x) for c in df.columns]) for t, x in _TABLES.items()}
    out["mirror"] = out["customer"].repartition(3)
    out["accounts"] = out["supplier"].select(F.col("nationkey").alias("Nation.Key"), F.col("acctbal").alias("acct bal"), F.col("acctbal").alias("ACCTBAL"))
    return out


#: Features: all columns of numbers, and others of at most 50 values; customers carry the target.
_COLUMNS = """c AS (SELECT * FROM (VALUES ('customer',0,'custkey','n'),('customer',2,'nationkey','n'),('customer',3,'acctbal','n'),('supplier',0,'suppkey','n'),('supplier',2,'nationkey','n'),('supplier',3,'acctbal','n'),
 ('nation',0,'nationkey','n'),('nation',2,'regionkey','n'),('part',0,'partkey','n'),('part',4,'size','n'),('part',5,'retailprice','n'),('orders',0,'orderkey','n'),('orders',1,'custkey','n'),('orders',3,'totalprice','n'),('accounts',0,'Nation.Key','n'),('accounts',1,'acct bal','n'),('accounts',2,'ACCTBAL','n')) v(t,i,c,k)
 UNION ALL SELECT 'customer', 1, 'name', 'c' WHERE (SELECT count(DISTINCT c_name) FROM customer)<=50 UNION ALL SELECT 'supplier', 1, 'name', 'c' WHERE (SELECT count(DISTINCT s_name) FROM supplier)<=50
 UNION ALL SELECT 'nation', 1, 'name', 'c' WHERE (SELECT count(DISTINCT n_name) FROM nation)<=50 UNION ALL SELECT 'part', 1, 'name', 'c' WHERE (SELECT count(DISTINCT p_name) FROM part)<=50 UNION ALL SELECT 'part', 2, 'brand', 'c' WHERE (SELECT count(DISTINCT p_brand) FROM part)<=50
 UNION ALL SELECT 'part', 3, 'type', 'c' WHERE (SELECT count(DISTINCT p_type) FROM part)<=50 UNION ALL SELECT 'orders', 2, 'orderstatus', 'c' WHERE (SELECT count(DISTINCT o_orderstatus) FROM orders)<=50 UNION ALL SELECT 'orders', 4, 'orderdate', 'c' WHERE (SELECT count(DISTINCT o_orderdate) FROM orders)<=50
 UNION ALL SELECT 'orders', 5, 'orderpriority', 'c' WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders)<=50),
 n AS (SELECT t, i, c, regexp_replace(regexp_replace(lower(c),'[ .-]+','_','g'),'[^0-9a-z_]','','g') q FROM c UNION ALL SELECT 'mirror', i, c, c FROM c WHERE t='customer'),
 r AS (SELECT 'customer' t, count(*) n FROM customer UNION ALL SELECT 'mirror', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'accounts', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders),
 s AS (SELECT t, list(c ORDER BY i) f, (SELECT coalesce(list(g.q ORDER BY g.i),[]) FROM n g WHERE g.t='customer' AND (SELECT count(*) FROM n o WHERE o.t=n.t AND o.q=g.q)=1) s FROM n GROUP BY t)"""


@register("plan_roles", f"""WITH {_COLUMNS} SELECT t AS "table", CASE WHEN t='customer' THEN 'gold' WHEN t='mirror' OR len(s)<2 THEN 'unusable' ELSE 'supplementary' END AS role,
 CASE WHEN t='customer' THEN 'primary' WHEN t='mirror' THEN 'mirror of the primary table' WHEN len(s)<2 THEN 'too few shared features' ELSE 'evidence' END AS reason, array_to_string(f,',') AS features, array_to_string(s,',') AS shared, n AS n_rows FROM s JOIN r USING(t)""")
def plan_roles(spark, d):
    """Roles for the target mktsegment; two of its three features must be shared."""
    told = p.assemble_plan(p.signatures(_tables(spark, d)), "mktsegment")
    return told.select("table", "role", "reason", F.array_join("features", ",").alias("features"), F.array_join("shared", ",").alias("shared"), "n_rows")


@register("plan_pool", """WITH a AS (SELECT c_nationkey nationkey, c_acctbal acctbal, 'customer' origin FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier) SELECT origin, nationkey, count(*) AS n, round(sum(acctbal),2) AS total FROM a GROUP BY 1,2""")
def plan_pool(spark, d):
    """Rows of the labelled table and its evidence over the features that all share."""
    tables = _tables(spark, d)
    plan = p.assemble_plan(p.signatures({k: tables[k] for k in ("customer", "supplier", "part")}), "mktsegment")
    features = [r.feature for r in p.common_features(plan).orderBy("position").collect()]
    used = [r.table for r in plan.where("role <> 'unusable'").collect()]
    rows = p.pooled_rows({t: tables[t] for t in used}, features)
    return rows.groupBy("origin", "nationkey").agg(F.count("*").alias("n"), F.round(F.sum("acctbal"), 2).alias("total"))
