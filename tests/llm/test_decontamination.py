from pyspark.sql import functions as F

from spectrafold.llm.decontamination import brute_force, find_contamination, is_contaminated

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
DOCS = [
    (1, "Pre " + ITEM.upper().replace(" ", ", ") + " post"),
    (2, " ".join(ITEM.split()[:12])),
    (3, None),
    (4, ""),
    (5, "short! ITEM?" + " word" * 100),
    (5, "short! ITEM?" + " word" * 100),
    (6, ("filler " * 700) + ITEM + " " + ITEM),
    (7, "größe ÜBER 1 2 3"),
    (8, "w " * 60000 + ITEM),
]
ITEMS = [(10, ITEM), (2, ITEM + " sixteen"), (3, "short item"), (4, None), (5, "?!"), (6, "GRÖSSE größe Über"), (None, "word word")]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("row", F.lit(None).cast("string"))
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def digest(found):
    out = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), is_contaminated())
    return sorted(map(tuple, out.collect()))


def test_against_brute_force(spark):
    docs, items = frames(spark)
    want = sorted(brute_force(DOCS, [x for x in ITEMS if x[0] is not None]))
    assert digest(find_contamination(docs, items)) == want
    assert digest(find_contamination(docs, items, block_bytes=60)) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert all(r.n_hit == 0 for r in find_contamination(docs, items.limit(0)).collect())
    assert find_contamination(docs.limit(0), items).count() == 0
