"""Greedy choice in an order, without going through the rows one by one.

A row is kept unless it matches a row before it that is kept.  Matching is
through cells: a cell is a kind of key with a value (an identifier, a title), a
row holds some cells, and a cell may look at other cells of its kind that are
like it.  A row matches a row before it if they share a cell, or if it holds a
cell that looks at a cell of the other.

The rows are decided in rounds.  In a round the rows that no undecided row
before them can reach are kept, and what they reach is dropped; in each cell
only the least undecided and the least kept row count, so that a key shared by a
third of all rows costs two aggregations with map-side combination and no pairs.
That gives what the sequential choice gives.  Rounds go on until all rows are
decided; a round reads only what the round before left undecided.

Like titles are looked for among all pairs of like lengths, which is exact:
titles of a ratio of at least 0.9 differ in few characters, so counts of
characters, compared in tiles of chunks in order of length, and then of pairs of
characters rule nearly all others out; the ratio itself is computed for the
pairs left, in Arrow batches.  A task holds two chunks of bounded text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectrafold.operators.relations import token_pairs
from spectrafold.operators.statistics import numbered
from spectrafold.session import bounded_batches, cut_lineage

_CELL = ["kind", "key"]
#: Titles of a chunk, of 256 characters or fewer, and rows of it compared at a time.
CHUNK, TILE = 1024, 256


def _reach(cells: DataFrame, looks: DataFrame | None, value: str, back: bool) -> DataFrame:
    """The least ``value`` that each cell meets: its own and those of the cells it looks at, or (``back``) of which it is seen."""
    own = cells.groupBy(*_CELL).agg(F.min(value).alias(value))
    if looks is None:
        return own
    seen = own if back else own.withColumnRenamed("key", "other")
    met = looks.join(seen, ["kind", "other"] if not back else _CELL)
    met = met.select("kind", F.col("other").alias("key") if back else "key", value)
    return own.unionByName(met).groupBy(*_CELL).agg(F.min(value).alias(value))


def greedy_first(rows: DataFrame, order: str, cells: DataFrame, looks: DataFrame | None = None, kinds: list[str] | None = None) -> DataFrame:
    """``rows(order)`` with ``kept``, ``matched_on`` and ``matched``.

    ``order`` has no value twice and none is null.  ``cells(order, kind, key)``
    are the keys of the rows, ``looks(kind, key, other)`` says which keys match
    an earlier ``other`` beside the same key.  ``matched_on`` is the first kind in
    the order of ``kinds`` (alphabetical otherwise) by which a dropped row
    matches a kept one before it, ``matched`` the first such row.
    """
    cells = cut_lineage(cells.select(F.col(order).alias("row"), "kind", "key").where("key IS NOT NULL").distinct())
    looks = None if looks is None else cut_lineage(looks.select("kind", "key", "other").where("key <> other").distinct())
    watchers = None if looks is None else looks.select("kind", F.col("other").alias("key"), F.col("key").alias("other"))
    open_cells, kept = cells, cells.select("row").limit(0)
    while not open_cells.isEmpty():
        first = _reach(open_cells, looks, "row", back=False).withColumnRenamed("row", "first")
        new = open_cells.join(first, _CELL).groupBy("row").agg(F.bool_and(F.col("row") <= F.col("first")).alias("free")).where("free").select("row")
        new = cut_lineage(new)
        blocked = _reach(open_cells.join(new, "row", "left_semi"), watchers, "row", back=True).withColumnRenamed("row", "by")
        gone = open_cells.join(blocked, _CELL).where("row > by").select("row").union(new).distinct()
        kept = kept.union(new)
        open_cells = cut_lineage(open_cells.join(gone, "row", "left_anti"))
    kept = cut_lineage(kept)
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) if kinds else F.col("kind")
    by = _reach(cells.join(kept, "row", "left_semi"), looks, "row", back=False).withColumnRenamed("row", "by")
    match = cells.join(by, _CELL).where("by < row").groupBy("row").agg(F.min(F.struct(rank.alias("rank"), F.col("by"), F.col("kind"))).alias("match"))
    match = match.join(kept, "row", "left_anti")
    out = rows.join(match, rows[order] == match["row"], "left")
    return out.select(*[rows[c] for c in rows.columns], match["row"].isNull().alias("kept"), F.col("match.kind").alias("matched_on"), F.col("match.by").alias("matched"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(new: pd.Series, old: pd.Series) -> pd.Series:
    """Share of matching characters of two texts (Ratcliff and Obershelp): twice the matched over all characters."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(new, old)], dtype=float)


def _near(threshold: float):
    """Pairs of two chunks of titles that counts of characters, and of pairs of them, don't rule out."""

    def counted(keys: list[str]) -> np.ndarray:
        """How often characters occur in each text, by the last bits of their codes; more than fit count as the most."""
        out = np.zeros((len(keys), 64), np.int16)
        for i, k in enumerate(keys):
            out[i] = np.minimum(np.bincount(np.frombuffer(k.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64), 1 << 14)
        return out

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for same, a, b in zip(part["same"], part["a"], part["b"]):
                counts, lengths = (counted(a), counted(b)), (np.array([len(k) for k in a]), np.array([len(k) for k in b]))
                grams: list[dict] = [{}, {}]

                def pairs(side: int, at: int, key: str) -> Counter:
                    if at not in grams[side]:
                        grams[side][at] = Counter(zip(key, key[1:]))
                    return grams[side][at]

                keys, others = [], []
                for at in range(0, len(a), TILE):
                    most = (1 - threshold) * (lengths[0][at : at + TILE, None] + lengths[1][None, :]) + 1e-9
                    apart = np.zeros(most.shape, np.int32)
                    for k in range(64):
                        one, two = counts[0][at : at + TILE, k], counts[1][:, k]
                        if one.any() or two.any():
                            apart += np.abs(one[:, None] - two[None, :])
                    for x, y in np.argwhere(apart <= most):
                        x += at
                        if same and x >= y:
                            continue
                        least = max(len(a[x]), len(b[y])) - 1 - 2 * int((1 - threshold) * (len(a[x]) + len(b[y])) + 1e-9)
                        if (pairs(0, x, a[x]) & pairs(1, y, b[y])).total() >= least:
                            keys.append(a[x])
                            others.append(b[y])
                yield pd.DataFrame({"key": keys, "other": others}, dtype=object)

    return near


def similar_titles(titles: DataFrame, title: str, threshold: float = 0.9) -> DataFrame:
    """``(key, other, ratio)`` of distinct titles whose ratio, with ``other`` as the earlier one, is at least the threshold."""
    if threshold < 0.9:
        raise ValueError("a ratio of less than 0.9 leaves too many pairs")
    each = titles.select(F.col(title).alias("key")).where(F.length(title) > 0).distinct().withColumn("n", F.length("key"))
    bounded_batches(titles.sparkSession)
    # Chunks in order of length; of longer titles a chunk has fewer.
    double = F.pow(F.lit(2.0), F.ceil(F.log2("n")))
    placed = numbered(each.withColumn("double", double), ["n", "key"], "at")
    placed = placed.withColumn("chunk", F.floor(F.col("at") / F.greatest(F.lit(1.0), F.least(F.lit(float(CHUNK)), F.lit(CHUNK * 256.0) / F.col("double")))))
    chunks = placed.groupBy("double", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.collect_list("key").alias("keys"))
    chunks = cut_lineage(chunks.withColumn("id", F.struct("least", "double", "chunk")))
    sides = [chunks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "least", "most")]) for s in "ab"]
    # Of n characters and more of them, m, a ratio r needs m <= n (2 - r) / r.
    fits = (F.col("id_a") <= F.col("id_b")) & (F.col("least_b") <= F.col("most_a") * ((2 - threshold) / threshold) + 1e-9)
    tasks = 4 * titles.sparkSession.sparkContext.defaultParallelism
    met = sides[0].crossJoin(sides[1]).where(fits).select("id_a", "id_b").repartition(tasks, "id_a", "id_b")
    for s in "ab":
        met = met.join(chunks.select(F.col("id").alias(f"id_{s}"), F.col("keys").alias(s)), f"id_{s}")
    met = met.select((F.col("id_a") == F.col("id_b")).alias("same"), "a", "b")
    met = cut_lineage(met.mapInPandas(_near(threshold), "key string, other string"))
    both = met.union(met.select("other", "key")).repartition(tasks, "key", "other")
    return both.withColumn("ratio", sequence_ratio("key", "other")).where(F.col("ratio") >= threshold)


def title_cell(title: Column) -> Column:
    """A title as it is compared: lower case, outer white space gone, null if nothing is left."""
    said = F.regexp_replace(F.lower(title.cast("string")), r"(?U)^\s+|\s+$", "")
    return F.when(said != "", said)


def multi_key_dedup(df: DataFrame, order: str, keys: dict[str, Column], title: Column | None = None, threshold: float = 0.9) -> DataFrame:
    """Rows kept in an order by several identifiers, in the order given, and a title like that of a kept row.

    A row without any key is kept.  An empty identifier is none.
    """
    kinds = {**{k: F.when(F.length(c.cast("string")) > 0, c.cast("string")) for k, c in keys.items()}, **({} if title is None else {"title": title_cell(title)})}
    held = df.select(order, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds.items()])).alias("cell")).select(order, "cell.*")
    looks = None
    if title is not None:
        looks = similar_titles(held.where("kind = 'title' AND key IS NOT NULL"), "key", threshold).select(F.lit("title").alias("kind"), "key", "other")
    return greedy_first(df, order, held, looks, list(kinds))


def redundancy_filter(df: DataFrame, order: str, text: Column, threshold: float, seen: DataFrame | None = None, seen_text: str = "text") -> DataFrame:
    """Rows kept in an order unless their words are like those of a kept row, or of a text in ``seen``.

    Likeness is the Jaccard similarity of the sets of lower-case words, at least ``threshold``.
    """
    words = lambda c: F.nullif(F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))), " "), F.lit(""))
    held = df.select(order, words(text).alias("key"))
    every = held.select("key") if seen is None else held.select("key").union(seen.select(words(F.col(seen_text))))
    sets = every.where("key IS NOT NULL").distinct().withColumn("id", F.col("key"))
    pairs = cut_lineage(token_pairs(sets, "id", F.col("key"), threshold).select(F.col("id").alias("key"), "other"))
    both = pairs.union(pairs.select("other", "key"))
    rows = df
    if seen is not None:
        old = seen.select(words(F.col(seen_text)).alias("old")).distinct()
        known = both.join(old, both["other"] == old["old"], "left_semi").select("key").union(old.select("old")).distinct()
        known = held.join(known, "key", "left_semi").select(order)
        rows, held = df.join(known, order, "left_anti"), held.join(known, order, "left_anti")
    told = greedy_first(rows, order, held.select(order, F.lit("words").alias("kind"), "key"), both.select(F.lit("words").alias("kind"), "key", "other"))
    if seen is None:
        return told
    return told.unionByName(df.join(known, order, "left_semi").select("*", F.lit(False).alias("kept"), F.lit("seen").alias("matched_on"), F.lit(None).cast(df.schema[order].dataType).alias("matched")))


def first_of_all(items: list[tuple], alike) -> Iterator[tuple]:
    """The sequential choice, for tests: each item with the first kept one that it matches, or None."""
    kept: list[tuple] = []
    for item in items:
        by = next((k for k in kept if alike(item, k)), None)
        if by is None:
            kept.append(item)
        yield item, by
