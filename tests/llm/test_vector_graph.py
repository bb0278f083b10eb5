import numpy as np

import pyarrow as pa

from spectrafold.llm import vector_graph as g


def rows():
    rng = np.random.default_rng(4)
    out = []
    for lab in range(3):
        for c in range(12):
            base = rng.normal(size=16)
            for _ in range(25):
                out.append((len(out), (base + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.8])).astype(np.float32).tolist(), lab))
    for i in range(40):
        out.append((len(out), out[0][1], 0))
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    out += [(len(out) + i, v, 0) for i, v in enumerate(bad)]
    out += [(len(out), out[0][1], None), (len(out) + 1, [1.0, 0.0], 0), (len(out) + 2, [1.0, 0.01], 0)]
    return out


def test_links_and_components(spark):
    data = rows()
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    result = g.near_vectors(table)
    got = {r.vec_id: r for r in result.collect()}
    assert len(got) == len(data)
    same_size = [d for d in data if d[1] is None or len(d[1]) == 16]
    want = g.brute_force(same_size)
    true, found = sum(map(len, want.values())), sum(got[i].n_links for i in want)
    assert 0.97 * true <= found <= true
    assert all(got[i].n_links <= len(w) for i, w in want.items())
    for i, *_ in data[-8:-2]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[data[-1][0]].component_id == data[-2][0]
    assert g.audit_recall(table.where("size(embedding) = 16 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0)"), result) >= 0.95
    assert g.near_vectors(table.limit(0)).count() == 0


def test_recall_over_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = []
    for _ in range(8):  # groups wider than the pool of candidates leave a shard's graph in pieces
        base = rng.normal(size=24)
        base /= np.linalg.norm(base)
        for _ in range(150):
            data.append((len(data), (base + rng.normal(size=24) * 0.05).astype(np.float32).tolist(), 0))
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    true = sum(map(len, g.brute_force(data).values()))
    for shard in (g.SHARD, 100):
        monkeypatch.setattr(g, "SHARD", shard)
        result = g.near_vectors(table).cache()
        found = sum(r.n_links for r in result.collect())
        assert 0.97 * true <= found <= true, shard
        assert g.audit_recall(table, result) >= 0.95


def test_very_small_and_very_large_vectors(spark):
    rows = [(1, [1e-60, 1e-60], 1), (2, [1.0, 1.0], 1), (3, [1e200, 1e-3], 1), (4, [1e39, 1.0], 1), (5, [1e200, 1e200], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in g.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3)}


def test_pairs_are_verified_in_step():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x = rng.normal(size=3 + i % 2) * 10.0 ** rng.integers(-200, 200)
        rows.append((i, i + 1, x.tolist(), ((x / np.abs(x).max() + rng.normal(size=len(x)) * 0.3) * 10.0 ** rng.integers(-200, 200)).tolist()))
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    want = [(a, b) for a, b, x, y in rows if unit(x) @ unit(y) >= g.BOUND]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["a", "b", "x", "y"])
    got = [(r["a"], r["b"]) for out in g._verified(whole.slice(i, 90) for i in range(0, 400, 90)) for r in out.to_pylist()]
    assert got == want and 50 < len(want) < 350
