import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import bpe, packing

pytest.importorskip("public_tokenizers")


def test_best_fit_equals_linear_scan():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 80))), reverse=True)
        rows, want = [], []
        for n in lengths:
            fits = [(room, i) for i, room in enumerate(rows) if room >= n]
            if not fits:
                rows.append(capacity)
                fits = [(capacity, len(rows) - 1)]
            room, i = min(fits)
            rows[i] -= n
            want.append(room - n)
        got = packing.best_fit(lengths, capacity)
        load = {}
        room_after = []
        for n, row in zip(lengths, got):
            load[row] = load.get(row, 0) + n
            room_after.append(capacity - load[row])
        assert room_after == want and max(load.values(), default=0) <= capacity


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "größe", "x"]) for _ in range(rng.randint(1, 200)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "word " * 30000), (203, "same"), (203, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = bpe.public_vocabulary()
    packed = packing.pack(docs, vocabulary, 128, 4000)
    got = packed.collect()
    assert all(len(r.ids) == 256 == len(r.position_ids) and r.cu_seqlens[-1] == r.n_tokens <= 128 for r in got)
    for r in got:
        positions = np.frombuffer(r.position_ids, dtype="<u2")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
    back = {}
    for r in packing.unpack(packed).collect():
        back.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(np.frombuffer(r.ids, dtype="<u2").tolist())
    codec = bpe.Codec(vocabulary)
    for i, text in rows:
        said = codec.encode([text])[0] + [vocabulary.special["<|endoftext|>"]]
        parts = back[i]
        assert sum((parts[p][0] for p in sorted(parts)), []) == said
    assert len(back[203][0]) == 2
    total = sum(r.n_tokens for r in got)
    assert total / (128 * len(got)) > 0.95
    assert packing.pack(docs.limit(0), vocabulary).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    said = [("a", "one two " * 150), ("a", "three four " * 150), ("a", "three four " * 150), (None, "five")]
    docs = spark.createDataFrame(said, "key string, text string").withColumn("copy", F.lit("clash")).withColumn("ids", F.lit(1))
    vocabulary = bpe.public_vocabulary()
    rows = packing.unpack(packing.pack(docs, vocabulary, 64, id_col="key")).collect()
    back = {}
    for r in rows:
        back.setdefault((r.doc_id, r.copy), {}).setdefault(r.piece, []).append(np.frombuffer(r.ids, dtype="<u2").tolist())
    codec, end = bpe.Codec(vocabulary), vocabulary.special["<|endoftext|>"]
    restored = sorted((doc or "", sum((parts[p][k] for p in sorted(parts)), [])) for (doc, _), parts in back.items() for k in range(len(parts[0])))
    assert restored == sorted((doc or "", codec.encode([text])[0] + [end]) for doc, text in said)
