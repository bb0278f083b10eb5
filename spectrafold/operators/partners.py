"""Which columns of two tables name the same things, and which table holds what another one labels.

All columns of a table that may be keys become one table of ``(column, key)``, so
every pair of columns is counted by one join on keys and one aggregation, however
many columns there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.operators.relations import barcode, barcode_join

_KEYS = ("string", "int", "bigint", "smallint", "tinyint")
_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def long_keys(df: DataFrame) -> DataFrame:
    """``(column, key)``: the distinct normalised values of every column of text or whole numbers; empty ones are none."""
    names = [c for c, t in df.dtypes if t in _KEYS]
    if not names:
        return df.select(F.lit("").alias("column"), F.lit("").alias("key")).limit(0)
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), barcode(F.col(f"`{c}`")).alias("key")) for c in names])))
    return each.where("key IS NOT NULL AND key <> ''").distinct()


def key_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """``(left_key, right_key, n_left, n_right, shared, fraction)`` of the pairs of columns that share a key; of the smaller side the share.

    With ``keys`` one column of a pair must be among them.
    """
    a, b = long_keys(left).withColumnRenamed("column", "left_key"), long_keys(right).withColumnRenamed("column", "right_key")
    met = a.join(b, "key").groupBy("left_key", "right_key").agg(F.count("*").alias("shared"))
    if keys is not None:
        met = met.where(F.col("left_key").isin(list(keys)) | F.col("right_key").isin(list(keys)))
    sizes = [t.groupBy(c).agg(F.count("*").alias(n)) for t, c, n in ((a, "left_key", "n_left"), (b, "right_key", "n_right"))]
    out = met.join(F.broadcast(sizes[0]), "left_key").join(F.broadcast(sizes[1]), "right_key")
    return out.select("left_key", "right_key", "n_left", "n_right", "shared", (F.col("shared") / F.least("n_left", "n_right")).alias("fraction"))


def best_key_pair(left: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The pair of the largest fraction, to six places, and then of most shared keys; ties go to the first names.  No row if nothing is shared."""
    rank = F.struct(F.round("fraction", 6), "shared")
    pairs = key_pairs(left, right, keys).withColumn("rank", rank)
    best = pairs.agg(F.max("rank").alias("best"))
    first = pairs.join(F.broadcast(best), F.col("rank") == F.col("best")).orderBy("left_key", "right_key").limit(1)
    return first.select("left_key", "right_key", "n_left", "n_right", "shared", "fraction")


def join_halves(labels: DataFrame, values: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Both halves of an experiment joined on their best pair of keys; an error if nothing is shared."""
    pair = best_key_pair(labels, values, keys).first()
    if pair is None:
        raise ValueError("no key occurs in both tables")
    return barcode_join(labels, values, pair.left_key, pair.right_key)


def partner_scores(labels: DataFrame, candidates: Mapping[str, DataFrame], most_label_columns: int = 200, least_columns: int = 50, ratio: float = 3.0) -> DataFrame:
    """``(table, left_key, right_key, shared, share)`` of each candidate wide enough to hold measurements: the best pair by the share of the labels' rows it has.

    A candidate needs ``least_columns`` numeric columns and ``ratio`` times those of the labels; labels
    with more than ``most_label_columns`` of them have their measurements already and no partner.
    """
    numbers = lambda df: sum(t in _NUMBERS for _, t in df.dtypes)
    own = numbers(labels)
    wide = {} if own > most_label_columns else {n: df for n, df in candidates.items() if numbers(df) >= max(least_columns, ratio * max(1, own))}
    keys = long_keys(labels).withColumnRenamed("column", "left_key")
    both = None
    for name, df in wide.items():
        part = long_keys(df).select(F.lit(name).alias("table"), F.col("column").alias("right_key"), "key")
        both = part if both is None else both.unionByName(part)
    if both is None:
        return keys.select(F.lit("").alias("table"), "left_key", F.lit("").alias("right_key"), F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("share")).limit(0)
    n = labels.agg(F.count("*").alias("n"))
    met = both.join(keys, "key").groupBy("table", "left_key", "right_key").agg(F.count("*").alias("shared")).crossJoin(F.broadcast(n))
    best = met.withColumn("share", F.col("shared") / F.col("n")).groupBy("table").agg(F.min(F.struct((-F.col("shared")).alias("k"), "left_key", "right_key", "shared", "share")).alias("b"))
    return best.select("table", "b.left_key", "b.right_key", "b.shared", "b.share")


def choose_partner(labels: DataFrame, candidates: Mapping[str, DataFrame], least_overlap: float = 0.3, **rules) -> str | None:
    """The candidate that has the largest share of the labels' rows, if it reaches the least; the first name of equal ones."""
    found = partner_scores(labels, candidates, **rules).where(F.col("share") >= least_overlap).orderBy(F.desc("share"), "table").limit(1).collect()
    return found[0].table if found else None
