"""Near-duplicate vectors by search in a robust-pruned flat graph.

1. Equal vectors of one label form a class; everything below works on classes.
2. Each label is cut into clusters around centroids fitted on a sample of at
   most ``SAMPLE`` classes; every class joins its ``OVERLAP`` nearest clusters.
3. Per cluster shard a flat graph is built: each vector's nearest candidates go
   through robust pruning, which drops a candidate that a kept one already
   leads to, and every edge is made mutual.  The shards' adjacency lists are
   united by vector.
4. Every class is searched for from the shard's medoid and its own vertex: greedy steps to the
   most similar unexpanded vector, and on as long as any seen within
   ``SLACK`` of the bound is unexpanded (range expansion).
5. Links found are expanded once more through the united lists, across shards,
   and all links are verified by cosine in double precision.

``audit_recall`` compares the links of a set of queries with brute force.

Shards are sized by counts, so more data gives more shards of the same size;
the work within a shard runs in numpy, where Spark partitions it.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of unequal
length have no cosine and no link; repeated ids are told apart only by their
vectors, and ``n_links`` counts rows, so that of equal rows each counts; ties in
similarity can change which edges a graph keeps, and so at most which links are
found, never whether a found one holds; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._store import Scratch
from spectrafold.llm.components import connected_components

BOUND = 0.93
SAMPLE = 20_000
SHARD = 1500
OVERLAP = 2
DEGREE = 24
POOL = 64
ALPHA = 1.2
STEPS = 40
SLACK = 0.06


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> list[np.ndarray]:
    """Out-neighbours of each unit vector: of its nearest candidates those that no kept one already leads to."""
    n = len(x)
    pool = min(pool, n - 1)
    out: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        if pool < 1:
            break
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1)
        near = np.take_along_axis(near, order, 1)
        gap = 1 - np.take_along_axis(sims, near, 1)
        inner = 1 - np.einsum("qid,qjd->qij", x[near], x[near])
        alive = np.ones(near.shape, dtype=bool)
        kept = np.zeros(near.shape, dtype=bool)
        for k in range(pool):
            take = alive[:, k] & (kept.sum(1) < degree)
            kept[:, k] = take
            alive &= ~(take[:, None] & (alpha * inner[:, k, :] <= gap))
        for i, row in enumerate(kept):
            for j in near[i, row].tolist():
                out[at + i].add(j)
                out[j].add(at + i)
    return [np.fromiter(sorted(s), dtype=np.int64, count=len(s)) for s in out]


def range_search(x: np.ndarray, lists: list[np.ndarray], bound: float = BOUND, slack: float = SLACK, steps: int = STEPS, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) pairs of similarity near ``bound`` or more, all vectors as queries, searched in step from the medoid and the query's own vertex."""
    n = len(x)
    width = max((len(v) for v in lists), default=0)
    table = np.full((n, max(1, width)), -1, dtype=np.int64)
    for i, v in enumerate(lists):
        table[i, : len(v)] = v
    small = x.astype(np.float32)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    for at in range(0, n, block):
        q = small[at : at + block]
        seen = np.full((len(q), n), -np.inf, dtype=np.float32)
        open_ = np.full((len(q), n), -np.inf, dtype=np.float32)
        start = q @ small[medoid]
        seen[:, medoid] = open_[:, medoid] = start
        # Its own neighbours are found however the steps from the medoid end.
        own = np.arange(len(q))
        seen[own, own + at] = open_[own, own + at] = 1.0
        live, step = np.arange(len(q)), 0
        while len(live):
            best = open_[live].argmax(1)
            value = open_[live, best]
            go = (value > -np.inf) & ((step < steps) | (value >= bound - slack))
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = -np.inf
            near = table[best]
            row, col = np.nonzero(near >= 0)
            who, what = live[row], near[row, col]
            new = seen[who, what] == -np.inf
            who, what = who[new], what[new]
            sims = np.einsum("nd,nd->n", q[who], small[what])
            seen[who, what] = sims
            open_[who, what] = sims
            step += 1
        a, b = np.nonzero(seen >= bound - 1e-4)
        other = a + at != b
        yield a[other] + at, b[other]


def _shard(part: pd.DataFrame) -> pd.DataFrame:
    """Edges (kind 0) and links (kind 1) of a shard."""
    ids = part["cid"].to_numpy()
    x = _unit(np.stack(part["vec"].to_numpy()))
    lists = robust_prune(x)
    edge = pd.DataFrame({"kind": 0, "a": np.repeat(ids, [len(v) for v in lists]), "b": ids[np.concatenate(lists)] if len(lists) else ids[:0]})
    out = [edge]
    for a, b in range_search(x, lists):
        exact = np.einsum("nd,nd->n", x[a], x[b]) >= BOUND
        a, b = ids[a[exact]], ids[b[exact]]
        out.append(pd.DataFrame({"kind": 1, "a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates())
    return pd.concat(out, ignore_index=True).astype({"kind": "int32", "a": "int64", "b": "int64"})


def _centroids(sample: pd.DataFrame, counts: dict) -> dict:
    """Per (label, length) some centroids, by a few rounds of spherical k-means."""
    out = {}
    for key, part in sample.groupby(["label", "size"]):
        x = _unit(np.stack(part["vec"].to_numpy()))
        k = max(1, min(len(x), -(-counts.get(key, len(x)) * OVERLAP // SHARD)))
        c = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(8):
            near = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
        out[key] = c
    return out


def _assigner(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for (label, size), some in part.groupby(["label", "size"]):
                c = shared.value[(label, size)]
                sims = _unit(np.stack(some["vec"].to_numpy())) @ c.T
                for rank in range(min(OVERLAP, sims.shape[1])):
                    near = np.argsort(-sims, axis=1, kind="stable")[:, rank]
                    yield some.assign(cluster=near.astype(np.int32))

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``a, b, x, y`` the pairs whose vectors have a cosine of ``BOUND`` or more in double precision."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        size, keep = x.value_lengths().to_numpy(), np.zeros(len(batch), dtype=bool)
        for k in np.unique(size):
            some = np.flatnonzero(size == k)
            p, q = (v.take(pa.array(some)).flatten().to_numpy().reshape(-1, k) for v in (x, y))
            keep[some] = np.einsum("nd,nd->n", _unit(p), _unit(q)) >= BOUND
        yield batch.select([0, 1]).filter(pa.array(keep))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row: id, ``n_links``, ``component_id`` and ``kept``."""
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    valid = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(F.forall("vec", fine) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(valid, F.xxhash64("vec")))
    good = rows.where(valid)
    classes = good.groupBy("label", "key", "vec").agg(F.min("id").alias("cid"), F.count("*").alias("times")).withColumn("size", F.size("vec"))
    classes = scratch.put(classes, "classes")
    counts = {(r["label"], r["size"]): r["n"] for r in classes.groupBy("label", "size").agg(F.count("*").alias("n")).collect()}
    sample = classes.orderBy(F.xxhash64("key", "cid")).limit(SAMPLE).select("label", "size", "vec").toPandas()
    centroids = _centroids(sample, counts) if len(sample) else {}
    for key in counts:  # a label the sample missed is one cluster
        centroids.setdefault(key, np.ones((1, key[1])))
    shared = spark.sparkContext.broadcast(centroids)
    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "size", "cid", "vec").mapInPandas(_assigner(shared), f"label {kind}, size int, cid long, vec array<double>, cluster int")
    found = scratch.put(placed.groupBy("label", "size", "cluster").applyInPandas(_shard, "kind int, a long, b long"), "found")
    links = scratch.put(found.where("kind = 1").select("a", "b").distinct(), "links")
    # The united adjacency lists lead from a link's ends to further vectors, also of other shards.
    united = found.where("kind = 0").select(F.col("a").alias("via"), F.col("b").alias("next")).distinct()
    both = links.union(links.select("b", "a"))
    further = both.join(united, both.b == united.via).select(F.least("a", "next").alias("a"), F.greatest("a", "next").alias("b")).where("a <> b").distinct()
    further = further.join(links, ["a", "b"], "left_anti")
    vectors = classes.select("cid", "vec")
    checked = further.join(vectors.select(F.col("cid").alias("a"), F.col("vec").alias("x")), "a").join(vectors.select(F.col("cid").alias("b"), F.col("vec").alias("y")), "b")
    more = checked.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")
    links = scratch.put(links.union(more), "all_links")
    groups = connected_components(links, scratch, "groups")
    ends = links.union(links.select("b", "a"))
    other = classes.select(F.col("cid").alias("b"), "times")
    degree = ends.join(other, "b").groupBy(F.col("a").alias("cid")).agg(F.sum("times").alias("linked"))
    told = classes.join(degree, "cid", "left").join(groups, classes.cid == groups.id, "left")
    told = told.select(F.col("label").alias("l"), F.col("key").alias("k"), F.col("vec").alias("v"), (F.col("times") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    told = scratch.put(told, "told")
    out = rows.join(told, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")) & (F.col("vec") == F.col("v")), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def brute_force(rows: list[tuple]) -> dict[int, set[int]]:
    """Links of every (id, vector, label), for tests and audits."""
    good = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in rows if v is not None and lab is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {i: set() for i, _, _ in rows}
    for lab in {g[2] for g in good}:
        part = [g for g in good if g[2] == lab]
        x = _unit(np.stack([v for _, v, _ in part]))
        ids = np.array([i for i, _, _ in part])
        for k, i in enumerate(ids.tolist()):
            out[i] |= {int(j) for j in ids[x @ x[k] >= BOUND] if j != i}
    return out


def audit_recall(table: DataFrame, result: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> float:
    """Share of the true links of the vectors whose id is divisible by 100 that ``n_links`` counts, against all vectors."""
    spark = table.sparkSession
    asked = table.where(F.col(id_col) % 100 == 0).select(id_col, vec_col, label_col).collect()
    shared = spark.sparkContext.broadcast([(r[0], _unit(np.array([r[1]], dtype=np.float64))[0], r[2]) for r in asked if r[1] is not None and r[2] is not None])

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = _unit(np.stack(part[vec_col].to_numpy()))
            n = [int(((x @ q >= BOUND) & (part[label_col].to_numpy() == lab) & (part[id_col].to_numpy() != i)).sum()) for i, q, lab in shared.value]
            yield pd.DataFrame({"q": [i for i, _, _ in shared.value], "n": n})

    true = table.select(id_col, vec_col, label_col).dropna().mapInPandas(count, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
    met = true.join(result, true.q == result[id_col]).agg(F.sum("n").alias("true"), F.sum("n_links").alias("found")).first()
    return 1.0 if not met["true"] else met["found"] / met["true"]


def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
