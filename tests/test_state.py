"""Ordered rules: the batch against plain Python, the stream against the batch."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spectrafold.streaming import state as st
from spectrafold.streaming.events import event_stream, run_once

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made(seed, n=240, keys="ab"):
    draw = random.Random(seed)
    rows, at = [], BEGIN
    for i in range(n):
        at += timedelta(seconds=draw.choice([0, 20, 300, 1500, 9000 if draw.random() < 0.05 else 60]))
        rows.append((draw.choice(keys), at, i, draw.choice(["get", "get", "set", "set", "delete", "clear" if draw.random() < 0.1 else "get", "peek" if draw.random() < 0.1 else "set"]), draw.choice("pqrstu"), float(draw.randint(0, 9))))
    return rows


SCHEMA = "key string, ts timestamp, tie long, op string, item string, amount double"


def cache_one_by_one(rows, capacity, life):
    caches, out = {}, []
    for key, at, tie, op, item, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        cache, evicted = caches.setdefault(key, OrderedDict()), None
        if cache and all(at > e for e in cache.values()):
            cache.clear()
        if op == "get":
            outcome = "miss"
            if item in cache and at > cache[item]:
                outcome = "expired"
                del cache[item]
            elif item in cache:
                outcome = "hit"
                cache.move_to_end(item)
        elif op == "set":
            if len(cache) >= capacity and item not in cache:
                evicted = cache.popitem(last=False)[0]
            cache[item] = at + timedelta(seconds=life)
            cache.move_to_end(item)
            outcome = "stored"
        elif op == "delete":
            outcome = "deleted" if cache.pop(item, None) else "absent"
        else:
            outcome = "cleared" if op == "clear" else "ignored"
            if op == "clear":
                cache.clear()
        out.append((key, tie, outcome, evicted))
    return sorted(out)


def test_cache(spark):
    rows = made(1, 400, "abc")
    got = st.replay(spark.createDataFrame(rows, SCHEMA).repartition(5), st.CacheRule(3, 3600)).collect()
    assert sorted((r.key, r.tie, r.outcome, r.evicted) for r in got) == cache_one_by_one(rows, 3, 3600)
    assert {r.outcome for r in got} == {"hit", "miss", "expired", "stored", "deleted", "absent", "cleared", "ignored"} and any(r.evicted for r in got)
    with pytest.raises(ValueError):
        st.CacheRule(0, 1)


def test_budget_by_hand(spark):
    hours = lambda h: BEGIN + timedelta(hours=h)
    rows = [("k", hours(0), 1, None, None, 30.0), ("k", hours(1), 2, None, None, 25.0), ("k", hours(23), 3, None, None, 60.0), ("k", hours(24), 4, None, None, None), ("k", hours(47.9), 5, None, None, 10.0), ("k", hours(60), 6, None, None, 1.0)]
    got = st.replay(spark.createDataFrame(rows, SCHEMA), st.BudgetRule(100, 1)).collect()
    said = sorted((r.kind, (r.started.replace(tzinfo=timezone.utc) - BEGIN).total_seconds() / 3600, r.spent, r.n, r.threshold or 0) for r in got)
    assert said == [("alert", 0, 55.0, 2, 50.0), ("alert", 0, 115.0, 3, 75.0), ("alert", 0, 115.0, 3, 90.0), ("alert", 0, 115.0, 3, 100.0), ("period", 0, 115.0, 3, 0), ("period", 24, 10.0, 2, 0), ("period", 60, 1.0, 1, 0)]


@pytest.mark.parametrize("rule", [st.CacheRule(3, 3600), st.BudgetRule(60, 0.25)], ids=["cache", "budget"])
def test_stream_equals_batch(spark, tmp_path, rule):
    """Files come out of order by less than the watermark allows; a last event of another key pushes the watermark on."""
    rows = made(7)
    size = 24
    files = [rows[i : i + size] for i in range(0, len(rows), size)]
    for k in range(0, len(files) - 1, 2):
        late = [r for r in files[k] if files[k + 1][0][1] - r[1] < timedelta(minutes=50)][-6:]
        files[k], files[k + 1] = [r for r in files[k] if r not in late], files[k + 1] + late
    files.append([("end", rows[-1][1] + timedelta(days=30), 10**6, "get", "p", 1.0)])
    files.append([("end", rows[-1][1] + timedelta(days=60), 10**6 + 1, "get", "p", 1.0)])
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03}")
    # One folder a file keeps their order by modification time.
    stream = event_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], SCHEMA).schema)
    run_once(st.replay_stream(stream, rule, "1 hour"), str(tmp_path), "out")
    got = spark.read.parquet(f"{tmp_path}/out").where("key <> 'end'")
    want = st.replay(spark.createDataFrame(rows, SCHEMA), rule)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_empty_and_incomplete_events(spark):
    df = spark.createDataFrame([(None, BEGIN, 1), ("a", None, 2)], "key string, ts timestamp, tie long")
    events = st.events_of(df, F.col("key"), "ts", "tie")
    assert st.replay(events, st.CacheRule(2, 1)).count() == 0 and st.replay(events, st.BudgetRule(1, 1)).count() == 0
