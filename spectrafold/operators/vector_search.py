"""Nearest vectors by cosine through inverted lists, exactly.

Vectors are put in cells around centroids.  A cell knows its size and its
radius, the largest angle between its centroid and a member, so by the triangle
inequality of angles no member is nearer to a query than the query's angle to the
centroid less the radius.  A search first visits as few of its nearest cells as
hold enough vectors, which gives each query a similarity to beat, and then all cells
that may hold a better one: the result is that of a full scan.  A filter is
applied before, so cells count only what passes it.

Queries and cells meet by cell and piece: a cell's vectors and its queries are
cut into pieces of a bounded number of rows and multiplied as matrices, and only the best
``k`` of each piece leave it.  Centroids come from a bounded sample (``SAMPLE``),
every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.session import bounded_batches, cut_lineage

SAMPLE, PIECE, MOST_CELLS = 20_000, 4096, 1024
#: Angles of rounded vectors are off by less than this.
SLACK = 1e-6


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction, with it as ``unit`` in double precision; null, zero and non-finite vectors go."""
    v = F.col(vector).cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return df.where(square.isNotNull() & (square > 0) & (square < float("inf"))).withColumn("unit", F.transform(v, lambda x: x / F.sqrt(square)))


def fit_centroids(units: DataFrame, id_col: str, cells: int | None = None, rounds: int = 8) -> np.ndarray:
    """Directions of the cells: spherical k-means of the ``SAMPLE`` rows of least hash, about the root of the number of rows, at most ``MOST_CELLS``."""
    n = units.count()
    if not n:
        return np.zeros((0, 1))
    share = min(1.0, 1.5 * SAMPLE / n)
    sampled = units.select("unit", F.xxhash64(F.col(id_col).cast("string")).alias("h")).where(F.lit(share >= 1.0) | (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))))
    x = np.array([r.unit for r in sampled.orderBy("h").limit(SAMPLE).collect()])
    k = min(cells or int(np.ceil(np.sqrt(n))), MOST_CELLS, len(x))
    centre = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centre)
    return centre


def build_index(df: DataFrame, id_col: str, vector: str, cells: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(the rows with ``unit``, ``cell`` and ``angle`` to its centroid, written once; the centroids)."""
    units = unit_vectors(df, vector)
    centre = fit_centroids(units, id_col, cells)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(centre)

    @F.pandas_udf("cell int, angle double")
    def nearest(unit: pd.Series) -> pd.DataFrame:
        dot = _matrix(unit) @ shared.value.T
        best = dot.argmax(axis=1)
        return pd.DataFrame({"cell": best.astype(np.int32), "angle": np.arccos(np.clip(dot[np.arange(len(dot)), best], -1, 1))})

    if not len(centre):
        return units.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)}), centre
    return cut_lineage(units.withColumn("__at", nearest("unit")).select(*units.columns, "__at.*")), centre


def _pieces(df: DataFrame, sizes: DataFrame, key: Column) -> DataFrame:
    """Rows with ``piece``, of about ``PIECE`` rows of a cell each, and the cell's number of ``pieces``."""
    cut = sizes.select("cell", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"))
    return df.join(F.broadcast(cut), "cell").withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int"))


def _visit(queries: DataFrame, pairs: DataFrame, rows: DataFrame, id_col: str, k: int) -> DataFrame:
    """``(query, id, similarity)``: of each query and piece of a cell of ``pairs(query, cell)`` the best ``k``."""
    asked = pairs.join(queries, "query")
    asked = _pieces(asked, asked.groupBy("cell").agg(F.count("*").alias("size")), F.col("query")).select("query", "q", "cell", F.col("piece").alias("ask"), F.col("pieces").alias("asks"))
    held = _pieces(rows, rows.groupBy("cell").agg(F.count("*").alias("size")), F.col(id_col)).select(F.col(id_col).alias("id"), "unit", "cell", "piece", "pieces")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    counts_a = asked.select(F.col("cell").alias("c"), F.col("asks").alias("n")).distinct()
    counts_h = held.select(F.col("cell").alias("c"), F.col("pieces").alias("n")).distinct()
    asked = asked.join(F.broadcast(counts_h), F.col("cell") == F.col("c")).select("query", "q", "cell", "ask", each("n").alias("piece"))
    held = held.join(F.broadcast(counts_a), F.col("cell") == F.col("c")).select("id", "unit", F.col("cell").alias("cell"), F.col("piece").alias("piece"), each("n").alias("ask"))
    kind = f"query {dict(asked.dtypes)['query']}, id {dict(held.dtypes)['id']}, similarity double"

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": left["query"][:0], "id": right["id"][:0], "similarity": np.zeros(0)})
        right = right.sort_values("id")
        similar = np.round(_matrix(left["q"]) @ _matrix(right["unit"]).T, 12)
        top = np.argsort(-similar, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query": np.repeat(left["query"].to_numpy(), top.shape[1]), "id": right["id"].to_numpy()[top].ravel(), "similarity": np.take_along_axis(similar, top, axis=1).ravel()})

    return asked.groupBy("cell", "piece", "ask").cogroup(held.groupBy("cell", "piece", "ask")).applyInPandas(best, kind)


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(index: tuple[DataFrame, np.ndarray], queries: DataFrame, query: str, vector: str, k: int, id_col: str, where: Column | None = None, least: float = -1.0, exclude_self: bool = False, exclude: DataFrame | None = None) -> DataFrame:
    """``(query, id, similarity, rank)``: for each query its ``k`` most similar rows of a similarity of at least ``least``.

    Rows pass the filter ``where``; rows whose id is in ``exclude(id)`` and, with ``exclude_self``, the
    query's own id are never answers.  Similarities are rounded to 12 places and equal ones go to
    the least id.  Queries without direction have no answers.
    """
    rows, centre = index
    rows = rows if where is None else rows.where(where)
    if exclude is not None:
        rows = rows.join(exclude.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    asked = unit_vectors(queries, vector).select(F.col(query).alias("query"), F.col("unit").alias("q")).where("query IS NOT NULL").dropDuplicates(["query"])
    empty = asked.join(rows.select(F.col(id_col).alias("id")).limit(0), F.lit(False)).select("query", "id", F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    cells = rows.groupBy("cell").agg(F.count("*").alias("size"), F.max("angle").alias("radius")).collect() if len(centre) else []
    if not cells:
        return empty
    # With itself among the answers a query needs one more.
    need = k + 1 if exclude_self else k
    ids, size, radius = (np.array(x) for x in zip(*((r.cell, r.size, r.radius) for r in cells)))
    shared = index[0].sparkSession.sparkContext.broadcast((ids, size, radius, centre[ids]))
    asked = cut_lineage(asked)
    qtype = dict(asked.dtypes)["query"]

    def bounds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, size, radius, centre = shared.value
        for part in parts:
            angle = np.arccos(np.clip(_matrix(part["q"]) @ centre.T, -1, 1))
            bound = np.maximum(0.0, angle - radius - SLACK)
            order = np.argsort(angle, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1)
            first = np.zeros_like(order, dtype=bool)
            np.put_along_axis(first, order, np.c_[np.zeros(len(part)), held[:, :-1]] < need, axis=1)
            n = len(ids)
            yield pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), n), "cell": np.tile(ids, len(part)).astype(np.int32), "reach": np.cos(bound).ravel(), "first": first.ravel()})

    pairs = cut_lineage(asked.mapInPandas(bounds, f"query {qtype}, cell int, reach double, first boolean"))
    near = cut_lineage(_visit(asked, pairs.where("first").select("query", "cell"), rows, id_col, need))
    beat = near.groupBy("query").agg(F.array_sort(F.collect_list(-F.col("similarity"))).alias("s"))
    beat = beat.select("query", F.when(F.size("s") >= need, -F.get("s", F.lit(need - 1))).otherwise(-1.0).alias("beat"))
    more = pairs.where("NOT first").join(beat, "query", "left").where(F.col("reach") >= F.greatest(F.coalesce("beat", F.lit(-1.0)), F.lit(least)) - SLACK)
    found = near.unionByName(_visit(asked, more.select("query", "cell"), rows, id_col, need)).where(F.col("similarity") >= least)
    if exclude_self:
        found = found.where(~F.col("query").cast("string").eqNullSafe(F.col("id").cast("string")))
    return _top(found, k).select("query", "id", "similarity", "rank")


def _blocks(rows: int):
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), rows):
                some = part.iloc[a : a + rows]
                yield pd.DataFrame({"ids": [some["id"].to_numpy()], "flat": [np.concatenate(some["e"].to_numpy())]})

    return cut


def _nearest(k: int, rows: int = 256):
    """The ``k`` nearest of a block to each query: products of matrices say which may be, sums in the order of the components how near."""

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        in_order = lambda x: np.add.accumulate(x, axis=1)[:, -1]  # noqa: E731  the same for equal vectors, as a product of matrices is not
        for part in parts:
            for q_ids, q_flat, ids, flat in zip(part["q_ids"], part["q_flat"], part["ids"], part["flat"]):
                x, q = np.reshape(flat, (len(ids), -1)), np.reshape(q_flat, (len(q_ids), -1))
                norm, q_norm = np.sqrt(in_order(x * x)), np.sqrt(in_order(q * q))
                unit = (x / norm[:, None]).T
                for a in range(0, len(q), rows):
                    about = (q[a : a + rows] / q_norm[a : a + rows, None]) @ unit
                    about[q_ids[a : a + rows, None] == ids[None, :]] = -2.0
                    least = np.partition(about, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                    one, two = np.nonzero((about >= least[:, None] - 1e-9) & (about > -2.0))
                    s = in_order(q[a + one] * x[two]) / (q_norm[a + one] * norm[two])
                    order = np.lexsort((ids[two], -s, one))
                    one, two, s = one[order], two[order], s[order]
                    first = np.arange(len(one)) - np.searchsorted(one, one) < k
                    yield pd.DataFrame({"query_id": q_ids[a + one[first]], "vec_id": ids[two[first]], "s": s[first]})

    return nearest


def scan(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``(query_id, vec_id, s)``: of ``vectors(id, e)`` the ``k`` nearest of each block to each query, by cosine and then id, without the query itself.

    Vectors have one length, finite components and a direction.  Queries and vectors meet in pairs of blocks, so no task holds either whole.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism
    block = f"ids array<{vectors.schema['id'].dataType.simpleString()}>, flat array<double>"
    every = cut_lineage(vectors.repartition(tasks, "id").mapInPandas(_blocks(2 * PIECE), block))
    asked = cut_lineage(vectors.where(is_query).coalesce(1 + tasks // 16).mapInPandas(_blocks(PIECE // 4), block)).toDF("q_ids", "q_flat")
    return every.crossJoin(asked).mapInPandas(_nearest(k), f"query_id {vectors.schema['id'].dataType.simpleString()}, vec_id {vectors.schema['id'].dataType.simpleString()}, s double")


def recommend(index: tuple[DataFrame, np.ndarray], liked: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """The rows most like the mean of some vectors, which are left out themselves; the query is called 0."""
    v = F.posexplode(F.col(vector).cast("array<double>"))
    centre = liked.where(F.col(vector).isNotNull()).select(v.alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    centre = centre.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean")).select(F.lit(0).alias("query"), "mean")
    return search(index, centre, "query", "mean", k, id_col, exclude=liked.select(F.col(id_col).alias("id")))
