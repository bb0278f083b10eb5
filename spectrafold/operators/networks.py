"""Graph steps, merging of records, rankings and joins of related rows.

Edges are tables ``(src, dst, ...)``.  Loops cut their lineage through the
shared checkpoint folder and expand only what is new.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators.relations import hops
from spectrafold.operators.statistics import numbered
from spectrafold.session import cut_lineage


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "__s", "dst": "src"}).withColumnRenamed("__s", "dst").select(*edges.columns)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reversed_edges(edges)).distinct()


def one_hop(edges: DataFrame, start: DataFrame, nodes: DataFrame, order: Sequence[Column], limit: int | None = None, edge: Column | None = None) -> DataFrame:
    """Nodes one edge away from those of ``start(node)`` with their own columns, edges filtered by ``edge``."""
    chosen = edges if edge is None else edges.where(edge)
    met = chosen.join(start, chosen.src == start.node, "left_semi").join(nodes, F.col("dst") == nodes.id).orderBy(*order)
    return met if limit is None else met.limit(limit)


def hops_any_way(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """:func:`hops` along edges of either direction."""
    return hops(undirected(edges.select("src", "dst")), start, depth)


def shortest_paths(edges: DataFrame, start: DataFrame, goal: DataFrame, depth: int) -> DataFrame:
    """``(root, node, distance, path)`` for goals within ``depth`` steps; of equally short paths the least."""
    reached = start.select(F.col("node").alias("root"), "node").distinct().withColumn("distance", F.lit(0)).withColumn("path", F.array("node"))
    edges = cut_lineage(edges.select("src", "dst").distinct())
    reached = ring = cut_lineage(reached)
    for k in range(1, depth + 1):
        step = ring.join(edges, ring.node == edges.src).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("root", "node").agg(F.min("path").alias("path")).join(reached.select("root", "node"), ["root", "node"], "left_anti")
        ring = cut_lineage(step.select("root", "node", F.lit(k).alias("distance"), "path"))
        reached = reached.unionByName(ring)
    return reached.where("distance > 0").join(goal, reached.node == goal.goal, "left_semi")


def closure(parents: DataFrame, depth: int) -> DataFrame:
    """``(ancestor, node, distance)`` of a table of ``(node, parent)`` pairs."""
    edges = parents.where("parent IS NOT NULL AND parent <> node").select(F.col("parent").alias("src"), F.col("node").alias("dst")).distinct()
    return hops(edges, edges.select(F.col("src").alias("node")), depth).withColumnRenamed("root", "ancestor")


def clusters(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """``(id, cluster)``: the least id reachable along edges of either direction, nodes without edges by themselves."""
    both = cut_lineage(undirected(edges.select("src", "dst").where("src <> dst")))
    labels = cut_lineage(nodes.select("id").distinct().withColumn("cluster", F.col("id")))
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.id).select(both.src.alias("id"), "cluster")
        least = near.union(labels).groupBy("id").agg(F.min("cluster").alias("cluster"))
        far = least.select(F.col("id").alias("at"), F.col("cluster").alias("further"))
        moved = least.join(far, least.cluster == far["at"], "left").join(labels.select(F.col("id").alias("was"), F.col("cluster").alias("old")), F.col("id") == F.col("was"))
        moved = cut_lineage(moved.select("id", F.least("cluster", "further").alias("cluster"), (F.least("cluster", "further") != F.col("old")).alias("changed")))
        labels = moved.select("id", "cluster")
        if moved.where("changed").isEmpty():
            return labels
    raise RuntimeError(f"clusters still move after {rounds} rounds")


def valid_edges(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Edges with both ends, no loop, a known kind and a confidence within [0, 1]."""
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & F.col("kind").isin(*kinds) & F.col("confidence").between(0, 1))


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys, and the rest of ``new`` added; of repeated new rows the last by order of all columns counts."""
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*new.columns) if rest else new.select(*keys).distinct()
    return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when some nodes go, with all edges at them."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def appended(df: DataFrame, key: str, notes: DataFrame, note: str, column: str) -> DataFrame:
    """An array column with each row's notes added at its end, in sorted order."""
    more = notes.groupBy(key).agg(F.array_sort(F.collect_list(note)).alias("__more"))
    return df.join(more, key, "left").withColumn(column, F.concat(F.coalesce(column, F.array().cast("array<string>")), F.coalesce("__more", F.array().cast("array<string>")))).drop("__more")


def symmetric_top(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of each source its ``k`` heaviest edges from a threshold on, both ways, and a loop at every node."""
    w = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    top = edges.where((F.col("weight") >= threshold) & (F.col("src") != F.col("dst"))).withColumn("p", F.row_number().over(w)).where(F.col("p") <= k).select("src", "dst")
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    return undirected(top).union(nodes.select("src", F.col("src").alias("dst"))).distinct()


def edge_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Undirected edges of both graphs, those shared, Jaccard and containment in the smaller."""
    plain = lambda e: e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = plain(first).withColumn("l", F.lit(1)).join(plain(second).withColumn("r", F.lit(1)), ["a", "b"], "full_outer")
    out = both.agg(F.count("l").alias("n_first"), F.count("r").alias("n_second"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"))
    return out.withColumn("jaccard", F.try_divide("shared", F.col("n_first") + F.col("n_second") - F.col("shared"))).withColumn("containment", F.try_divide("shared", F.least("n_first", "n_second")))


def conflicts(findings: DataFrame, group: str, order: str, effect: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Each finding beside the one before it on the same matter: sign flipped, significance lost or gained, or in accord."""
    w = W.partitionBy(group).orderBy(order)
    both = findings.withColumns({"e0": F.lag(effect).over(w), "p0": F.lag(p).over(w)})
    kind = F.when(F.col("e0").isNull(), "first").when(F.signum("e0") * F.signum(effect) < 0, "sign").when((F.col("p0") < alpha) != (F.col(p) < alpha), "significance").otherwise("accord")
    return both.withColumn("conflict", kind).drop("e0", "p0")


def mapped_join(left: DataFrame, mapping: DataFrame, right: DataFrame) -> DataFrame:
    """``left(id, change)`` renamed by ``mapping(id, other)`` where it has a name, joined with ``right(id, change)``; whether both change one way."""
    named = left.join(mapping, "id", "left").select(F.coalesce("other", "id").alias("id"), F.col("change").alias("first"))
    both = named.join(right.withColumnRenamed("change", "second"), "id")
    return both.withColumn("concordant", F.signum("first") == F.signum("second"))


def both_ways(mapping: DataFrame, least: float) -> DataFrame:
    """Pairs of a mapping and their reverse from a confidence on."""
    good = mapping.where(F.col("confidence") >= least)
    return good.select("a", "b", "confidence").union(good.select("b", "a", "confidence"))


def union_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have it, the first's."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def vote_ranking(df: DataFrame, item: str, rank: str) -> DataFrame:
    """Items by number of lists that hold them, then mean rank, then name."""
    votes = df.groupBy(item).agg(F.count("*").alias("votes"), F.avg(rank).alias("mean_rank"))
    return numbered(votes, [F.desc("votes"), F.col("mean_rank"), F.col(item)], "place")


def best_strategy(df: DataFrame, names: DataFrame, name: str, success: Column) -> DataFrame:
    """The name of highest success rate, an untried one counted as 1, ties to the least name."""
    tried = df.groupBy(name).agg(F.avg(success.cast("double")).alias("rate"))
    rated = names.join(tried, name, "left").select(name, F.coalesce("rate", F.lit(1.0)).alias("rate"))
    return rated.orderBy(F.desc("rate"), name).limit(1)


def merged_candidates(df: DataFrame, key: str, query: str, pool: str, score: str, per_pool: int) -> DataFrame:
    """Candidates found by several queries as one row each with the queries that found them, and the best of each pool."""
    one = df.groupBy(key, pool).agg(F.array_sort(F.collect_set(query)).alias("queries"), F.max(score).alias("score"))
    w = W.partitionBy(pool).orderBy(F.desc("score"), F.desc(F.size("queries")), key)
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_pool)


def top_magnitudes(df: DataFrame, group: str, item: str, value: str, k: int) -> DataFrame:
    """Of each group the ``k`` items of greatest magnitude."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.abs(F.col(value))), item))).where(F.col("place") <= k)


def evict(df: DataFrame, order: str, size: str, most: float, share: float = 0.8) -> DataFrame:
    """Rows that stay when the oldest go until the sizes sum to ``share`` of ``most``; all stay under it.

    Sizes are summed from the newest on by ranges of the order.
    """
    placed = numbered(df, [F.desc(order)], "__r").withColumn("__b", F.floor(F.col("__r") / 4096))
    blocks = placed.groupBy("__b").agg(F.sum(size).alias("__s"))
    before = blocks.withColumn("__before", F.sum("__s").over(W.orderBy("__b")) - F.col("__s")).select("__b", "__before")
    run = placed.join(F.broadcast(before), "__b").withColumn("__upto", F.col("__before") + F.sum(size).over(W.partitionBy("__b").orderBy("__r")))
    total = df.agg(F.sum(size).alias("__total"))
    return run.crossJoin(F.broadcast(total)).where((F.col("__total") <= most) | (F.col("__upto") <= share * most)).select(*df.columns)


def alerts_per_period(df: DataFrame, period: Column, order: str, amount: str, thresholds: Sequence[float]) -> DataFrame:
    """The row at which a period's running amount first reaches each threshold."""
    run = df.withColumn("period", period).withColumn("spent", F.sum(amount).over(W.partitionBy(period).orderBy(order)))
    each = run.select("period", F.col(order).alias("at"), "spent", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")).where("spent >= threshold")
    return each.groupBy("period", "threshold").agg(F.min("at").alias("at"))


def trailing_activity(df: DataFrame, time: str, minutes: int, by: str) -> DataFrame:
    """Rows of each kind in the last minutes of the table, and their share of all of those."""
    last = df.agg(F.max(time).alias("__now"))
    recent = df.crossJoin(F.broadcast(last)).where(F.col(time) > F.col("__now") - F.make_dt_interval(mins=F.lit(minutes)))
    counts = recent.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select(by, "n", (F.col("n") / F.col("t")).alias("share"))


def with_cooldown(df: DataFrame, key: str, time: str, condition: Column, minutes: float) -> DataFrame:
    """Rows that meet a condition and come at least a cooldown after the last one reported of their key.

    The times of a key are folded in order as a partition is read, so a key of
    any size needs the memory of one batch.
    """
    gap = round(minutes * 60e6)
    kind = df.schema[key].dataType.simpleString()

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for part in parts:
            keep = []
            for k, t in zip(part["k"], part["t"]):
                if last is None or k != now or t - last >= gap:
                    now, last = k, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield part[keep]

    # The key as it is sorted by tells null apart from every value.
    rows = df.where(condition & F.col(time).isNotNull()).select(F.col(key).alias("v"), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t")).distinct()
    told = rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(fold, f"v {kind}, k string, t long")
    return told.select(F.col("v").alias(key), F.timestamp_micros("t").alias(time))


def expired(df: DataFrame, time: str, now: Column, seconds: float) -> DataFrame:
    return df.where(F.unix_micros(now) - F.unix_micros(F.col(time)) > seconds * 1e6)


def retained(df: DataFrame, importance: Column, recent: Column, used: Column) -> DataFrame:
    """Rows that are important, recent or used."""
    return df.where(importance | recent | used)


def text_matches(df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """Rows of which any field contains the query, whatever its case."""
    low = query.lower()
    test = F.lit(False)
    for f in fields:
        test = test | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(low))
    return df.where(test)


def any_name_all_words(df: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """Rows whose text has all words of at least one of the names."""
    test = F.lit(False)
    for name in names:
        every = F.lit(True)
        for word in name.lower().split():
            every = every & F.contains(F.lower(text), F.lit(word))
        test = test | every
    return df.where(test)


def project(df: DataFrame, prefixes: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """Columns with one of the prefixes (all if none is given) that are not excluded."""
    return df.select(*[c for c in df.columns if c not in excluded and (not prefixes or any(c.startswith(p) for p in prefixes))])


def aligned(df: DataFrame, wanted: Sequence[str], least_share: float = 0.5) -> DataFrame:
    """Columns renamed to those wanted where their plain forms agree one to one; an error if too few do."""
    plain = lambda n: "".join(ch for ch in n.lower() if ch.isalnum())
    forms: dict[str, list[str]] = {}
    for c in df.columns:
        forms.setdefault(plain(c), []).append(c)
    found = {w: forms[plain(w)][0] for w in wanted if len(forms.get(plain(w), ())) == 1}
    least = max(2, -(-int(least_share * len(wanted) * 1000) // 1000))
    if len(found) < least:
        raise ValueError(f"only {len(found)} of {len(wanted)} columns found; {least} are needed")
    return df.select(*[F.col(c).alias(w) for w, c in found.items()])


def pooled(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Tables of one schema as one, with ``origin``; ids are prefixed by it and so stay distinct."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(key, F.concat_ws(":", F.lit(name), F.col(key).cast("string"))).withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
