"""Joins, set operations, deduplication, ranking, splits and graph steps as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.operators.statistics import numbered, quantiles
from spectrafold.session import cut_lineage


def barcode(key: Column) -> Column:
    """A key without one trailing ``-N`` or ``.N``."""
    return F.regexp_replace(F.trim(key.cast("string")), r"[-.][0-9]+$", "")


def barcode_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, suffix: str = "_expr") -> DataFrame:
    """Inner join on normalised keys; columns that clash get the suffix on the right."""
    clash = set(left.columns)
    right = right.select(barcode(F.col(right_key)).alias("__key"), *[F.col(c).alias(c + suffix if c in clash else c) for c in right.columns])
    return left.withColumn("__key", barcode(F.col(left_key))).join(right, "__key").drop("__key")


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys of both sides, those shared, and their share of the smaller side."""
    both = left.select(F.col(left_key).alias("k")).distinct().withColumn("l", F.lit(1)).join(right.select(F.col(right_key).alias("k")).distinct().withColumn("r", F.lit(1)), "k", "full_outer")
    n = both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("shared"))
    return n.withColumn("overlap", F.col("shared") / F.least("n_left", "n_right")).withColumn("jaccard", F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared")))


def lookup(base: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """Left joins of one list with several evidence tables by the same key."""
    return reduce(lambda a, b: a.join(b, key, "left"), sides, base)


def overlap_violations(df: DataFrame, key: str, role: str) -> DataFrame:
    """Keys that occur under more than one role."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("roles")).where(F.size("roles") > 1)


def cooccurrence(df: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """Unordered pairs of items met in at least ``least`` distinct groups."""
    a = df.select(group, F.col(item).alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_groups")).where(F.col("n_groups") >= least)


def token_pairs(df: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """Pairs of token sets of a Jaccard similarity of at least the threshold, through shared tokens; of texts with one set the least id stands for all."""
    tokens = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+"))).alias("set"))
    tokens = tokens.groupBy("set").agg(F.min("id").alias("id"))
    each = tokens.select("id", F.explode("set").alias("t"))
    common = each.groupBy("t").agg(F.count("*").alias("c"))
    ranked = each.join(common, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ranked"))
    # Two sets that are similar share a token among the first of each, rare ones first.
    prefix = F.slice("ranked", 1, F.size("ranked") - F.ceil(F.lit(threshold) * F.size("ranked") - 1e-9).cast("int") + 1)
    first = ranked.select("id", F.explode(prefix).alias("x")).select("id", "x.t").join(tokens, "id")
    other = first.select(F.col("id").alias("other"), "t", F.col("set").alias("theirs"))
    fits = (F.col("id") < F.col("other")) & (F.least(F.size("set"), F.size("theirs")) >= threshold * F.greatest(F.size("set"), F.size("theirs")))
    both = F.size(F.array_intersect("set", "theirs"))
    scored = first.join(other, "t").where(fits).select("id", "other", (both / (F.size("set") + F.size("theirs") - both)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold).distinct()


def title_key(title: Column) -> Column:
    """Lower case, punctuation gone, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def first_key_dedup(df: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """The first row of each identity, where the first non-empty key alone identifies a row; rows without any go."""
    named = [F.when(F.length(F.trim(k)) > 0, F.concat(F.lit(f"{i}:"), F.lower(F.trim(k)))) for i, k in enumerate(keys)]
    keyed = df.withColumn("__id", F.coalesce(*named)).where("__id IS NOT NULL")
    first = keyed.groupBy("__id").agg(F.min(order).alias("__first"))
    return keyed.join(first, (keyed["__id"] == first["__id"]) & (keyed[order] == first["__first"]), "left_semi").drop("__id")


def weighted_rank(df: DataFrame, weights: dict[str, float], tie: str) -> DataFrame:
    """Weighted sum clipped to [0, 1] and its rank from 1, ties by ``tie``."""
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in weights.items()])
    scored = df.withColumn("score", F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))
    return numbered(scored, [F.desc("score"), F.col(tie)], "rank")


def trailing(df: DataFrame, series: str, order: str, value: str, width: int, threshold: float) -> DataFrame:
    """By series: whether its last ``width`` values all lie under the threshold, and whether they never rise."""
    recent = df.withColumn("__r", F.row_number().over(W.partitionBy(series).orderBy(F.desc(order)))).where(F.col("__r") <= width)
    last = recent.withColumn("__next", F.lag(value).over(W.partitionBy(series).orderBy(F.desc(order))))
    return last.groupBy(series).agg(
        F.count("*").alias("n"), (F.max(value) < threshold).alias("all_below"), F.coalesce(F.bool_and(F.col("__next") <= F.col(value)), F.lit(True)).alias("never_rises"),
    )


def run_since(df: DataFrame, series: str, order: str, reset: Column) -> DataFrame:
    """By series, the rows after its last row that meets ``reset``."""
    last = F.max(F.when(reset, F.struct(order))).over(W.partitionBy(series))
    return df.withColumn("__last", last).groupBy(series).agg(F.count_if(F.col("__last").isNull() | (F.struct(order) > F.col("__last"))).alias("run_length"))


def quintile_stage(df: DataFrame, value: str, significant: Column) -> DataFrame:
    """Stage 1 to 5 by the quintiles of the significant rows only; the largest value belongs to the last."""
    some = df.where(significant)
    wide = some.crossJoin(F.broadcast(quantiles(some, value, (0.2, 0.4, 0.6, 0.8))))
    stage = reduce(lambda a, b: a + b, [(F.col(value) >= F.col(f"q{i}")).cast("int") for i in range(4)]) + 1
    return wide.withColumn("stage", stage).drop("q0", "q1", "q2", "q3")


def stratified_split(df: DataFrame, id_col: str, label: str, test_share: float) -> DataFrame:
    """``test`` for the first rounded share of each class in hash order, at least one row of each class in ``train``."""
    quota = F.least(F.bround(F.col("__n") * F.lit(test_share)).cast("long"), F.col("__n") - 1)
    sizes = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n")).select("__l", quota.alias("__q"))
    return _first_by_hash(df, id_col, label, sizes).withColumn("split", F.when(F.col("__p") <= F.col("__q"), "test").otherwise("train")).drop("__q", "__p")


def _first_by_hash(df: DataFrame, id_col: str, label: str, sizes: DataFrame) -> DataFrame:
    """Rows with their place ``__p`` in hash order within their class and the class's quota ``__q``.

    All rows are numbered in order of class and hash, by ranges, and a class's
    first number is taken off, so a class of any size is spread over tasks.
    """
    placed = numbered(df.withColumn("__h", F.md5(F.col(id_col).cast("string"))), [F.col(label), F.col("__h")], "__g")
    first = placed.groupBy(F.col(label).alias("__l")).agg(F.min("__g").alias("__f"))
    told = sizes.join(first, sizes["__l"].eqNullSafe(first["__l"])).select(sizes["__l"], "__q", "__f")
    return placed.join(F.broadcast(told), placed[label].eqNullSafe(told["__l"])).withColumn("__p", F.col("__g") - F.col("__f") + 1).drop("__h", "__g", "__f", "__l")


def proportional_sample(df: DataFrame, id_col: str, label: str, most: int) -> DataFrame:
    """Of each class ``max(1, round(most n / N))`` rows, the first in hash order."""
    sizes = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    quota = F.greatest(F.lit(1), F.bround(F.lit(most) * F.col("__n") / F.col("__total")).cast("long"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("__n").alias("__total")))).select("__l", quota.alias("__q"))
    return _first_by_hash(df, id_col, label, sizes).where("__p <= __q").drop("__q", "__p")


def dominant(df: DataFrame, group: str, category: str, amount: str, least: float, share: float) -> DataFrame:
    """The largest category of each group: called if its amount and share suffice, else ambiguous."""
    sums = df.groupBy(group, category).agg(F.sum(amount).alias("amount"))
    best = sums.groupBy(group).agg(F.max_by(category, F.struct("amount", F.col(category))).alias("top"), F.max("amount").alias("top_amount"), F.sum("amount").alias("total"))
    good = (F.col("top_amount") >= least) & (F.col("top_amount") >= share * F.col("total"))
    return best.withColumn("call", F.when(good, F.col("top").cast("string")).otherwise("ambiguous"))


def hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``(root, node, distance)``: nodes within ``depth`` steps along ``edges(src, dst)``, with the least distance.

    Each step expands only the newest ring, drops nodes already reached and is
    written by itself.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    reached = cut_lineage(start.select(F.col("node").alias("root"), "node").distinct().withColumn("distance", F.lit(0)))
    ring = reached
    for k in range(1, depth + 1):
        step = ring.join(edges, ring.node == edges.src).select("root", F.col("dst").alias("node")).distinct()
        ring = step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(k))
        ring = cut_lineage(ring)
        reached = reached.unionByName(ring)
    return reached.where("distance > 0")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Ranks after a fixed number of rounds over ``edges(src, dst)``; what dead ends hold is spread evenly."""
    edges = cut_lineage(edges.distinct())
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    spread = edges.join(out, "src")
    ranks = nodes.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n")))).withColumn("rank", 1 / F.col("n"))
    for _ in range(rounds):
        lost = F.broadcast(ranks.join(out, ranks.id == out.src, "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")))
        got = spread.join(ranks, spread.src == ranks.id).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        ranks = ranks.join(got, ranks.id == got.dst, "left").crossJoin(lost).select("id", "n", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))).alias("rank"))
        ranks = cut_lineage(ranks)  # each round reads the ranks twice
    return ranks.select("id", "rank")


def top_neighbours(edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """Per target the ``k`` heaviest edges above a threshold."""
    w = W.partitionBy("dst").orderBy(F.desc("weight"), "src")
    return edges.where(F.col("weight") > threshold).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")
