import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from spectrafold.llm import toxicity as t
from spectrafold.llm._text import ALNUM, split_words, text_chunks


def tables(spark):
    rng = random.Random(7)
    words = ["w%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(40)] = rng.choice(["grrblax" + rng.choice("abcdef"), "zonkhead", "idiot"])
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(bad)))
    docs += [(1000, None), (1001, ""), (1001, ""), (1002, "idiot " * 30000)]
    labels += [(1, None), (None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("votes", F.lit("x"))
    return frame, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(spark):
    docs, labels = tables(spark)
    model = t.fit(docs, labels)
    rows = t.score(docs, model).withColumn("held", t.held_out()).collect()
    assert len(rows) == docs.count()
    hits = [(r.score >= t.THRESHOLD, r.doc_id % 5 == 0) for r in rows if r.held and r.doc_id < 900]
    assert sum(h for h, y in hits if y) >= 0.9 * sum(y for _, y in hits)
    assert sum(h for h, y in hits if not y) <= 0.05 * len(hits)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[1000] == by_id[1001] < t.THRESHOLD < by_id[1002]
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_do_not_count(spark):
    docs, labels = tables(spark)
    flipped = labels.withColumn("toxic", F.when(t.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = t.fit(docs, labels), t.fit(docs, flipped)
    assert (one.features == two.features).all() and (one.weights == two.weights).all()


def test_without_labels_or_rows(spark):
    docs, labels = tables(spark)
    model = t.fit(docs, labels.limit(0))
    assert {r.doc_id for r in t.score(docs, model).where(F.col("score") >= t.THRESHOLD).collect()} >= {1002}
    assert t.score(docs.limit(0), t.fit(docs.limit(0), labels)).count() == 0


def plain_patterns(text: str) -> tuple[bool, bool, bool]:
    """The patterns by regular expressions, one text at a time."""
    starred = any(re.search("[*#$]", m[0]) for m in re.finditer("(?<=[A-Za-z])[*#$@!]+(?=[A-Za-z])", text))
    alone = "(?<![A-Za-z0-9\x80-\U0010ffff])[A-Za-z](?![A-Za-z0-9\x80-\U0010ffff])"
    spaced = re.search(" ".join([alone] * 4), text)
    heated = re.search(r"([a-z])\1{3}", re.sub("[A-Z]", lambda m: m[0].lower(), text)) or "!!!" in text
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    addressed = any(w in t.ADDRESS and set(words[i + 1 : i + 1 + t.REACH]) & set(t.INSULTS) for i, w in enumerate(words))
    return bool(starred or spaced), bool(heated), bool(addressed)


def test_patterns_by_regular_expressions():
    rng = random.Random(2)
    texts = ["f**k", "a@b.com", "a@*b", "*a*", "x*", "*y", "a b c d", "a b c", "a b c dd", "1a b c d", "aaa", "Aaaa", "no!!!", "wow!!", "!", "", None, "you idiot", "you are such a loser", "you 1 2 3 4 loser", "you", "idiot", "e f g h i", "éa b c d"]
    pieces = ["a", "B", "b", " ", " ", "*", "!", "@", "you", "idiot", "scum", "é", "7", "aa", ". "]
    texts += ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(6000)]
    column, got = pa.array(texts), []
    for _, _, data, offsets in text_chunks(column, 5000):
        got += map(tuple, t.pattern_hits(data, offsets, split_words(data, offsets, ALNUM)).T.tolist())
    assert got == [plain_patterns(x or "") for x in texts]
    for k in range(3):
        assert 40 < sum(g[k] for g in got) < 5960


def test_patterns_vote(spark):
    """Toxic rows that no lexicon can know: each insult is starred in its own way."""
    rng = random.Random(11)
    words = ["w%d" % i for i in range(300)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(40)]
        if i % 5 == 0:
            text[rng.randrange(40)] = "".join(rng.choices(letters, k=3)) + "**" + "".join(rng.choices(letters, k=3))
        docs.append((i, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in docs if i % 3], "doc_id long, toxic int")
    held = [(r.score >= t.THRESHOLD, r.doc_id % 5 == 0) for r in t.score(frame, t.fit(frame, labels)).where(t.held_out()).collect()]
    assert all(h == y for h, y in held)
