import random

from pyspark.sql import functions as F

from spectrafold.llm.substring_dedup import WINDOW, brute_force, remove_repeats


def made(seed, docs, hot):
    """Texts of few and many words that share passages at all offsets; ``hot`` of them share one passage."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefgh") * draw.randint(1, 3) + str(draw.randint(0, 400))
    shared = [" ".join(word() for _ in range(n)) for n in (20, 34, 35, 36, 50, 53, 71, 120)]
    texts = []
    for k in range(docs):
        parts = []
        for _ in range(draw.randint(0, 4)):
            parts.append(" ".join(word() for _ in range(draw.choice([0, 1, 7, 33, 60]))))
            if draw.random() < 0.5:
                p = draw.choice(shared).split(" ")
                a = draw.randint(0, len(p) // 3)
                parts.append(draw.choice([" ", "\n", "\t \x0b"]).join(p[a:]))
        texts.append("  ".join(parts) + (" \n" + shared[5] if k < hot else ""))
    return texts


EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "a " * 34),
    (5, "a " * 36),
    (6, " ".join(str(i) for i in range(35))),
    (6, " ".join(str(i) for i in range(35))),
    (None, "x " + " ".join(str(i) for i in range(35))),
    (7, "é\u00a0ü é " * 20 + " ".join(f"Ä{i}" for i in range(40))),
    (8, "é\u00a0ü é " * 20 + " ".join(f"ä{i}" for i in range(40))),
    (9, " ".join(f"p{i % 7}" for i in range(90))),
    (10, "w" * 300000 + " " + " ".join(f"q{i}" for i in range(50))),
]


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("chunk", F.lit(None).cast("string"))
    got = remove_repeats(docs.repartition(3), **kw)
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    out = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=key) == sorted(brute_force(rows), key=key)
    assert all(sum(x.b - x.a for x in r.removed) == r.n_removed for r in out)
    return out


def test_edges(spark):
    out = check(spark, EDGES)
    assert {r.doc_id: r.n_removed for r in out}[9] == 90 and {r.doc_id: r.n_removed for r in out}[8] == 40


def test_many_texts_in_small_chunks(spark):
    for seed in range(3):
        rows = list(enumerate(made(seed, 120, 40)))
        out = check(spark, rows, chunk_bytes=[400, 3000, 1 << 20][seed], bucket_bytes=[2000, 40000, 1 << 20][seed])
        assert any(r.n_removed for r in out) and any(r.n_words > WINDOW and not r.n_removed for r in out)


def test_long_text_in_pieces(spark):
    passage = " ".join(f"z{i}" for i in range(60))
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [(1, f"{long} {passage} {long[:5000]}"), (2, passage[5:]), (3, "other words"), (4, long[9000:12000] + "\n" + passage)]
    out = check(spark, rows, chunk_bytes=700, bucket_bytes=3000)
    text = next(r for r in out if r.doc_id == 1)
    assert text.kept.split() and text.n_removed > 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).count() == 0
