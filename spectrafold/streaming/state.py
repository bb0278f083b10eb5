"""Rules that depend on the order of events, kept as state by key, for batches and streams alike.

A rule is a fold: it takes the events of one key in order of time and says what
each brings about.  ``replay`` folds a batch: keys are dealt over partitions and
sorted there, and only one key's state is held at a time.  ``replay_stream``
folds a stream with ``transformWithStateInPandas``: events wait in list state
until the watermark has passed them, so that they are folded in order however
late (up to the watermark) they come, the fold's state is a value, and timers
fold what is ripe, close what has run out and drop the state of idle keys.
Both give the same rows for the same events; those that come later than the
watermark allows are dropped by the stream.

Events have ``key`` (a string), ``ts``, a ``tie`` that orders events of one time,
``op``, ``item`` and ``amount``; events without key or time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_EVENT = ["at", "tie", "op", "item", "amount"]
_WAITING = "at bigint, tie bigint, op string, item string, amount double"


class CacheRule:
    """A cache that keeps at most ``capacity`` items, each for ``seconds`` after it was stored.

    ``get`` is a ``hit``, a ``miss`` or finds the item ``expired`` and drops it; a
    hit makes the item the last used.  ``set`` stores and, if the cache is full
    of other items, evicts the least recently used, expired or not.  ``delete``
    removes, ``clear`` empties.  Once all items have expired the cache is empty.
    """

    schema = "op string, item string, outcome string, evicted string"

    def __init__(self, capacity: int, seconds: float):
        if capacity < 1:
            raise ValueError("a cache holds at least one item")
        self.capacity, self.life = capacity, int(seconds * 1e6)

    def start(self) -> dict:
        return {}

    def step(self, state: dict, at: int, op: str, item: str, amount: float) -> Iterator[tuple]:
        evicted = None
        if state and at > max(state.values()):
            state.clear()
        if op == "get":
            if item not in state:
                outcome = "miss"
            elif at > state[item]:
                del state[item]
                outcome = "expired"
            else:
                state[item] = state.pop(item)
                outcome = "hit"
        elif op == "set":
            if len(state) >= self.capacity and item not in state:
                evicted = next(iter(state))
                del state[evicted]
            state.pop(item, None)
            state[item] = at + self.life
            outcome = "stored"
        elif op == "delete":
            outcome = "absent" if state.pop(item, None) is None else "deleted"
        elif op == "clear":
            state.clear()
            outcome = "cleared"
        else:
            outcome = "ignored"
        yield op, item, outcome, evicted

    def ends(self, state: dict) -> int | None:
        """The last moment at which the state matters."""
        return max(state.values(), default=None)

    def close(self, state: dict) -> Iterator[tuple]:
        return iter(())


class BudgetRule:
    """Spending against a limit by period; a period starts with the first event after the last one ended.

    An ``alert`` says, once for each threshold (in percent of the limit) and
    period, that spending has reached it; a ``period`` row closes a period.
    """

    schema = "kind string, started timestamp, spent double, n long, threshold double"

    def __init__(self, limit: float, days: float, thresholds: Sequence[float] = (50, 75, 90, 100)):
        self.limit, self.length, self.thresholds = limit, int(days * 86_400_000_000), sorted(map(float, thresholds))

    def start(self) -> dict:
        return {}

    def step(self, state: dict, at: int, op: str, item: str, amount: float) -> Iterator[tuple]:
        if state and at - state["start"] >= self.length:
            yield from self.close(state)
        if not state:
            state.update(start=at, spent=0.0, n=0, sent=0)
        state["spent"] += 0.0 if amount is None or amount != amount else amount
        state["n"] += 1
        share = state["spent"] / self.limit * 100 if self.limit > 0 else 0.0
        while state["sent"] < len(self.thresholds) and share >= self.thresholds[state["sent"]]:
            yield "alert", pd.Timestamp(state["start"], unit="us"), state["spent"], state["n"], self.thresholds[state["sent"]]
            state["sent"] += 1

    def ends(self, state: dict) -> int | None:
        return state["start"] + self.length if state else None

    def close(self, state: dict) -> Iterator[tuple]:
        if state:
            yield "period", pd.Timestamp(state["start"], unit="us"), state["spent"], state["n"], None
            state.clear()


def events_of(df: DataFrame, key: Column, time: str, tie: str, op: Column | None = None, item: Column | None = None, amount: Column | None = None) -> DataFrame:
    """A frame in the form that rules read."""
    none = F.lit(None)
    return df.where(key.isNotNull() & F.col(time).isNotNull()).select(
        key.cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(tie).cast("long").alias("tie"),
        (none if op is None else op).cast("string").alias("op"), (none if item is None else item).cast("string").alias("item"), (none if amount is None else amount).cast("double").alias("amount"),
    )


def _frame(rows: list[tuple], rule) -> pd.DataFrame:
    names = ["key", "ts", "tie", *[c.split()[0] for c in rule.schema.split(", ")]]
    return pd.DataFrame(rows, columns=names)


def _schema(rule) -> str:
    return f"key string, ts timestamp, tie long, {rule.schema}"


def _stamp(at: int) -> pd.Timestamp:
    return pd.Timestamp(at, unit="us")


def _plain(value):
    return None if value is None or value != value else value


def replay(events: DataFrame, rule) -> DataFrame:
    """What a rule says of each event of a batch; what is still open at the end of a key is closed there."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, last = None, rule.start(), None
        for part in parts:
            out = []
            for key, at, tie, op, item, amount in part.itertuples(index=False):
                if key != now:
                    out += [(now, *last, *row) for row in rule.close(state)]
                    now, state = key, rule.start()
                last = _stamp(at), _plain(tie)
                out += [(key, *last, *row) for row in rule.step(state, at, op, item, _plain(amount))]
            yield _frame(out, rule)
        if now is not None:
            yield _frame([(now, *last, *row) for row in rule.close(state)], rule)

    rows = events.select("key", F.unix_micros("ts").alias("at"), "tie", "op", "item", "amount")
    return rows.repartition("key").sortWithinPartitions("key", "at", "tie", "op", "item", "amount").mapInPandas(fold, _schema(rule))


class OrderedReplay(StatefulProcessor):
    """Folds the events of a key once the watermark has passed them."""

    def __init__(self, rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.state = handle.getValueState("state", "said string, at bigint, tie bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([tuple(_plain(v) for v in r) for r in zip(micros.tolist(), *(part[c].tolist() for c in _EVENT[1:]))])
            last = max(micros.max(), last or micros.max())
        if last is not None:
            self.handle.registerTimer(-(-int(last) // 1000))
        yield _frame([], self.rule)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        state, last = self.rule.start(), (None, None)
        if self.state.exists():
            said, *last = self.state.get()
            state = json.loads(said)
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        order = lambda r: tuple((v is not None, v) for v in r)
        ripe, rest = sorted((r for r in rows if r[0] <= now), key=order), [r for r in rows if r[0] > now]
        out = []
        for at, tie, op, item, amount in ripe:
            last = at, tie
            out += [(key[0], _stamp(at), tie, *row) for row in self.rule.step(state, at, op, item, amount)]
        if ripe:
            self.waiting.put(rest) if rest else self.waiting.clear()
        ends = self.rule.ends(state)
        if ends is not None and ends <= now and not rest:
            out += [(key[0], _stamp(last[0]), last[1], *row) for row in self.rule.close(state)]
            ends, state = None, self.rule.start()
        if state:
            self.state.update((json.dumps(state), *last))
            self.handle.registerTimer(ends // 1000 + 1)
        else:
            self.state.clear()
        yield _frame(out, self.rule)

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, rule, late: str = "1 hour") -> DataFrame:
    """:func:`replay` over a stream of events; state is held for keys whose rule is not closed.

    The session keeps state in RocksDB, which this API needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = events.withWatermark("ts", late)
    return marked.groupBy("key").transformWithStateInPandas(OrderedReplay(rule), _schema(rule), "Append", "EventTime")
