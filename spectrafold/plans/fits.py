"""Distributions, normality and broken lines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.operators import fits as f
from spectrafold.plans.inference import _z_p
from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table

_LOG_K = "ln(k+12) - 0.5/(k+12) - (1/12.0 - (1/120.0 - 1/252.0/((k+12)*(k+12)))/((k+12)*(k+12)))/((k+12)*(k+12)) - (" + "+".join(f"1/(k+{j})" for j in range(12)) + ")"

#: The shapes by bisection: of the gamma in log k - digamma(k), of the Weibull in the mean of logarithms weighted by powers.
_FITS = f"""WITH RECURSIVE x AS (SELECT o_orderstatus g, o_totalprice v, ln(o_totalprice) l FROM orders WHERE o_totalprice>0),
 s AS (SELECT g, count(*)::DOUBLE n, avg(v) m, stddev_pop(v) sd, avg(l) ml, stddev_pop(l) sl FROM x GROUP BY 1),
 c AS (SELECT g, v, ln(v)-ml z, count(*)::DOUBLE n FROM x JOIN s USING(g) GROUP BY 1,2,3),
 gm AS (SELECT g, ln(m)-ml t, 1e-3::DOUBLE lo, 1e4::DOUBLE hi, 0 i FROM s UNION ALL SELECT g, t, CASE WHEN e>t THEN k ELSE lo END, CASE WHEN e>t THEN hi ELSE k END, i+1 FROM (SELECT *, ln(k)-({_LOG_K}) e FROM (SELECT *, sqrt(lo*hi) k FROM gm WHERE i<70))),
 w AS (SELECT g, 0.02::DOUBLE lo, 50.0::DOUBLE hi, 0 i FROM s UNION ALL SELECT g, CASE WHEN e<0 THEN k ELSE lo END, CASE WHEN e<0 THEN hi ELSE k END, i+1 FROM (SELECT w.g, any_value(lo) lo, any_value(hi) hi, any_value(i) i, any_value(sqrt(lo*hi)) k, sum(n*exp(sqrt(lo*hi)*z)*z)/sum(n*exp(sqrt(lo*hi)*z))-1/any_value(sqrt(lo*hi)) e FROM w JOIN c ON c.g=w.g WHERE i<60 GROUP BY w.g)),
 p AS (SELECT s.*, gm.lo k, w.lo ws, (SELECT exp(s.ml+ln(sum(n*exp(w.lo*z))/sum(n))/w.lo) FROM c WHERE c.g=s.g) wl FROM s JOIN gm ON gm.g=s.g AND gm.i=70 JOIN w ON w.g=s.g AND w.i=60),
 f AS (SELECT g, n, 'norm' d, m a, sd b, 2 q, -n/2*(ln(2*pi()*sd*sd)+1) ll FROM p UNION ALL SELECT g, n, 'lognorm', ml, sl, 2, -n/2*(ln(2*pi()*sl*sl)+1)-n*ml FROM p UNION ALL SELECT g, n, 'expon', 1, m, 1, -n*(ln(m)+1) FROM p
  UNION ALL SELECT g, n, 'gamma', k, m/k, 2, (k-1)*n*ml-n*k-n*k*ln(m/k)-n*lgamma(k) FROM p UNION ALL SELECT g, n, 'weibull', ws, wl, 2, n*ln(ws)-n*ws*ln(wl)+(ws-1)*n*ml-n FROM p)"""


@register("fit_distributions", f"""{_FITS}, u AS (SELECT g, v, n, sum(n) OVER (PARTITION BY g ORDER BY v) t, sum(n) OVER (PARTITION BY g) n0 FROM c),
 k AS (SELECT g, max(greatest(t/n0-(1-exp(-pow(v/wl,ws))), (1-exp(-pow(v/wl,ws)))-(t-u.n)/n0)) k FROM u JOIN p USING(g) GROUP BY 1)
SELECT g AS o_orderstatus, d AS distribution, n::BIGINT AS n, round(a,5) AS shape, round(b,4) AS scale, round(ll,3) AS log_likelihood, round(2*q-2*ll,3) AS aic, 2*q-2*ll = min(2*q-2*ll) OVER (PARTITION BY g) AS best, CASE WHEN d='weibull' THEN round(k,6) ELSE -1 END AS weibull_ks FROM f JOIN k USING(g)""")
def fit_distributions(spark, d):
    """The distances of the distributions whose function SQL lacks are checked in tests/test_fits.py."""
    told = f.fit_distributions(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])
    ks = F.when(F.col("distribution") == "weibull", F.round("ks", 6)).otherwise(-1.0)
    return told.select("o_orderstatus", "distribution", "n", F.round("shape", 5).alias("shape"), F.round("scale", 4).alias("scale"), F.round("log_likelihood", 3).alias("log_likelihood"), F.round("aic", 3).alias("aic"), "best", ks.alias("weibull_ks"))


def _sql_polynomial(coefficients, x: str) -> str:
    out = repr(coefficients[-1]) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out}*{x}+({c!r}::DOUBLE))"
    return out


def _sql_quantile(p: str) -> str:
    ratio = lambda pair, x: f"{_sql_polynomial(pair[0], x)}/{_sql_polynomial(pair[1], x)}"
    r = f"sqrt(-ln(least({p},1-({p}))))"
    centre, outer = f"(({p})-0.5)*{ratio(f._CENTRE, f'(0.180625-(({p})-0.5)*(({p})-0.5))')}", f"CASE WHEN {r}<=5 THEN {ratio(f._MIDDLE, f'({r}-1.6)')} ELSE {ratio(f._TAIL, f'({r}-5)')} END"
    return f"CASE WHEN abs(({p})-0.5)<=0.425 THEN {centre} ELSE sign(({p})-0.5)*{outer} END"


@register("shapiro_wilk", f"""WITH x AS (SELECT c_acctbal v, row_number() OVER (ORDER BY c_acctbal) i, count(*) OVER () n FROM customer), m AS (SELECT v, i, n, {_sql_quantile('(i-0.375)/(n+0.25)')} m FROM x),
 t AS (SELECT sum(m*m) mm, max(m) m1, max(m) FILTER (WHERE i=n-1) m2, any_value(n)::DOUBLE n FROM m), a AS (SELECT *, m1/sqrt(mm)+{_sql_polynomial(f._LAST, '(1/sqrt(n))')} a1, m2/sqrt(mm)+{_sql_polynomial(f._LAST_BUT_ONE, '(1/sqrt(n))')} a2 FROM t),
 b AS (SELECT *, sqrt((mm-2*m1*m1-2*m2*m2)/(1-2*a1*a1-2*a2*a2)) e FROM a), w AS (SELECT any_value(b.n) n, pow(sum(v*CASE WHEN i=b.n THEN a1 WHEN i=b.n-1 THEN a2 WHEN i=1 THEN -a1 WHEN i=2 THEN -a2 ELSE m/e END),2)/(var_pop(v)*any_value(b.n)) w FROM m, b),
 z AS (SELECT n, w, (ln(1-w)-{_sql_polynomial(f._LARGE_MEAN, 'ln(n)')})/exp({_sql_polynomial(f._LARGE_SPREAD, 'ln(n)')}) z FROM w)
SELECT n::BIGINT AS n, round(w,8) AS w, round(CASE WHEN z>0 THEN ({_z_p('z')})/2 ELSE 1-({_z_p('z')})/2 END,6) AS p FROM z""")
def shapiro_wilk(spark, d):
    told = f.shapiro_wilk(table(spark, d, "customer"), "c_acctbal")
    return told.select("n", F.round("w", 8).alias("w"), F.round("p", 6).alias("p"))


@register("broken_line", """WITH x AS (SELECT (epoch_us(ts)-1704067200000000)/3600e6 x, value y FROM events), e AS (SELECT min(x) lo, max(x) hi, avg(x) mx, avg(y) my FROM x), d AS (SELECT least(23, floor((x-lo)/(hi-lo)*24))::INT k, x-mx a, y-my b FROM x, e),
 m AS (SELECT k, count(*)::DOUBLE n, sum(a) sx, sum(b) sy, sum(a*a) xx, sum(a*b) xy, sum(b*b) yy FROM d GROUP BY 1), r AS (SELECT i.k p, j.k q, sum(m.n) n, sum(m.sx) sx, sum(m.sy) sy, sum(m.xx) xx, sum(m.xy) xy, sum(m.yy) yy FROM m i JOIN m j ON i.k<=j.k JOIN m ON m.k BETWEEN i.k AND j.k GROUP BY 1,2),
 s AS (SELECT *, (xy-sx*sy/n)/(xx-sx*sx/n) b, yy-sy*sy/n-pow(xy-sx*sy/n,2)/(xx-sx*sx/n) e FROM r), o AS (SELECT u.q c1, v.q c2, u.e+v.e+w.e t FROM s u JOIN s v ON v.p=u.q+1 JOIN s w ON w.p=v.q+1 WHERE u.p=0 AND w.q=23 ORDER BY 3 LIMIT 1),
 l AS (SELECT s.*, o.t, o.c1, CASE WHEN p=0 THEN 1 WHEN q=23 THEN 3 ELSE 2 END k FROM s, o WHERE (p=0 AND q=c1) OR (p=c1+1 AND q=c2) OR (p=c2+1 AND q=23))
SELECT k AS segment, round(lo+(hi-lo)*p/24,6) AS from_x, round(lo+(hi-lo)*(q+1)/24,6) AS to_x, n::BIGINT AS n, round(b,8) AS slope, round(my+(sy-b*sx)/n-b*mx,5) AS intercept, round(1-t/(SELECT sum(yy)-pow(sum(sy),2)/sum(n) FROM m),8) AS r_squared FROM l, e""")
def broken_line(spark, d):
    """Values against hours, in 24 bins with two free breakpoints."""
    hours = table(spark, d, "events").select(((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600e6).alias("x"), F.col("value").alias("y"))
    told = f.broken_line(hours, "x", "y", 2, 24)
    return told.select("segment", F.round("from_x", 6).alias("from_x"), F.round("to_x", 6).alias("to_x"), "n", F.round("slope", 8).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r_squared", 8).alias("r_squared"))
