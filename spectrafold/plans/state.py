"""Caches and budgets replayed over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectrafold.plans.tabular import rounded
from spectrafold.registry import register
from spectrafold.session import table
from spectrafold.streaming import state as st

c = F.col


def cache_events(events):
    """Each user has a cache: purchases store, errors delete, everything else reads; the item is the event's ``k``."""
    op = F.when(c("event_type") == "purchase", "set").when(c("event_type") == "error", "delete").otherwise("get")
    return st.events_of(events, c("user_id"), "ts", "event_id", op, F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(7)))


@register("cache_replay", """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) t, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'get' END op, ((json_extract_string(props, '$.k')::INT)%7)::VARCHAR item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
 s AS (SELECT user_id, 0::BIGINT i, []::STRUCT(k VARCHAR, e BIGINT)[] x, NULL::BIGINT event_id, NULL::VARCHAR op, NULL::VARCHAR item, NULL::VARCHAR AS outcome, NULL::VARCHAR evicted FROM events GROUP BY 1 UNION ALL
 SELECT user_id, i, CASE WHEN op='get' AND live THEN list_append(rest, {k: item, e: old}) WHEN op='set' THEN list_append(CASE WHEN has OR len(x)<3 THEN rest ELSE rest[2:] END, {k: item, e: t+3*86400000000}) ELSE rest END, event_id, op, item,
  CASE op WHEN 'get' THEN CASE WHEN live THEN 'hit' WHEN has THEN 'expired' ELSE 'miss' END WHEN 'set' THEN 'stored' ELSE CASE WHEN has THEN 'deleted' ELSE 'absent' END END, CASE WHEN op='set' AND NOT has AND len(x)>=3 THEN x[1].k END
 FROM (SELECT *, len(list_filter(x, lambda v: v.k=item))>0 has, coalesce(list_filter(x, lambda v: v.k=item)[1].e >= t, false) live, list_filter(x, lambda v: v.k=item)[1].e old, list_filter(x, lambda v: v.k<>item) rest
  FROM (SELECT o.user_id, o.i, o.event_id, o.t, o.op, o.item, CASE WHEN o.t > coalesce(list_max(list_transform(s.x, lambda v: v.e)), 0) THEN [] ELSE s.x END x FROM s JOIN o ON o.user_id=s.user_id AND o.i=s.i+1)))
SELECT event_id, op, item, outcome, coalesce(evicted, '') AS evicted FROM s WHERE i>0""")
def cache_replay(spark, d):
    said = st.replay(cache_events(table(spark, d, "events")), st.CacheRule(3, 3 * 86400))
    return said.select(c("tie").alias("event_id"), "op", "item", "outcome", F.coalesce("evicted", F.lit("")).alias("evicted"))


@register("budget_alerts", """WITH RECURSIVE o AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, event_id FROM events),
 s AS (SELECT user_id, i, ts AS started, value AS spent, 1::BIGINT AS n, 0.0::DOUBLE before, event_id FROM o WHERE i=1 UNION ALL
 SELECT o.user_id, o.i, CASE WHEN new THEN o.ts ELSE started END, CASE WHEN new THEN o.value ELSE spent+o.value END, CASE WHEN new THEN 1 ELSE n+1 END, CASE WHEN new THEN 0 ELSE spent END, o.event_id FROM (SELECT s.*, o.ts-s.started >= INTERVAL 7 DAYS new, o i2 FROM s JOIN o ON o.user_id=s.user_id AND o.i=s.i+1) s JOIN o ON o.user_id=s.user_id AND o.i=s.i+1),
 a AS (SELECT 'alert' AS kind, user_id::VARCHAR AS key, started, spent, n, t::DOUBLE AS threshold FROM s, (VALUES (50),(75),(90),(100)) v(t) WHERE spent/120*100 >= t AND NOT before/120*100 >= t),
 p AS (SELECT 'period' AS kind, user_id::VARCHAR AS key, started, arg_max(spent, i) AS spent, max(n) AS n, -1.0::DOUBLE AS threshold FROM s GROUP BY user_id, started)
SELECT kind, key, started, round(spent,4) AS spent, n, threshold FROM a UNION ALL SELECT kind, key, started, round(spent,4), n, threshold FROM p""")
def budget_alerts(spark, d):
    spent = st.events_of(table(spark, d, "events"), c("user_id"), "ts", "event_id", amount=c("value"))
    said = st.replay(spent, st.BudgetRule(120.0, 7))
    return rounded(said.select("kind", "key", "started", "spent", "n", F.coalesce("threshold", F.lit(-1.0)).alias("threshold")))
