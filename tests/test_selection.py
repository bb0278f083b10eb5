"""Greedy selection against going through the rows one by one."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from spectrafold import registry
from spectrafold.operators import selection as s

DATA = "/root/testdata/sf0.001"


def ratio(new, old):
    return SequenceMatcher(None, new.lower().strip(), old.lower().strip()).ratio() if new and old else 0.0


def one_by_one(rows, titles=True, threshold=0.9):
    """(id, kept, kind, first kept row that matches by it) for rows of (id, doi, arxiv, title)."""
    kept, out = [], []
    for row in rows:
        hit = None
        for kind, at in (("doi", 1), ("arxiv", 2)):
            same = [k for k in kept if row[at] and row[at] == k[at]]
            if same and hit is None:
                hit = (kind, same[0][0])
        if hit is None and titles:
            near = [k for k in kept if ratio(row[3], k[3]) >= threshold]
            hit = ("title", near[0][0]) if near else None
        if hit is None:
            kept.append(row)
        out.append((row[0], hit is None, *(hit or (None, None))))
    return out


def made(seed, n):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdefg hij") for _ in range(draw.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        title = list(draw.choice(stems))
        for _ in range(draw.randint(0, 5)):
            title[draw.randrange(len(title))] = draw.choice("xyz ")
        rows.append((i, draw.choice([None, "", f"10.{draw.randint(0, 30)}"]), draw.choice([None, f"a{draw.randint(0, 40)}"]), draw.choice([None, "", "A", "  ", "".join(title), "".join(title).upper()])))
    return rows


def test_several_keys_and_titles(spark):
    for seed in range(2):
        rows = made(seed, 120)
        df = spark.createDataFrame(rows, "id long, doi string, arxiv string, title string").withColumns({"row": F.lit("clash"), "kept_before": F.lit(1), "key": F.lit("clash")})
        got = s.multi_key_dedup(df.repartition(4), "id", {"doi": F.col("doi"), "arxiv": F.col("arxiv")}, F.col("title"))
        want = one_by_one([(i, d, a, t if t and t.strip() else None) for i, d, a, t in rows])
        assert sorted(map(tuple, got.select("id", "kept", "matched_on", "matched").collect())) == want
        assert {w[2] for w in want} == {None, "doi", "arxiv", "title"}


def test_a_chain_is_decided_in_order(spark):
    """Each row matches the one before and the one after: every second one stays."""
    rows = [(i, f"k{i}", f"l{i - 1}") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, one string, two string")
    cells = df.select("id", F.explode(F.array(*[F.struct(F.lit("x").alias("kind"), F.regexp_replace(c, "^.", "").alias("key")) for c in ("one", "two")])).alias("c")).select("id", "c.*")
    got = s.greedy_first(df, "id", cells).select("id", "kept", "matched").collect()
    assert sorted((r.id, r.kept, r.matched) for r in got) == [(i, i % 2 == 0, None if i % 2 == 0 else i - 1) for i in range(12)]


def test_similar_titles_finds_all_pairs(spark):
    draw = random.Random(5)
    titles = sorted({t.lower().strip() for _, _, _, t in made(7, 150) if t and t.strip()} | {"a", "ab", "aba", "abab" * 60, "abab" * 59 + "abb", "é" * 9, "é" * 10, "".join(draw.choice("ab") for _ in range(250))})
    got = {(r.key, r.other): r.ratio for r in s.similar_titles(spark.createDataFrame([(t,) for t in titles], "t string"), "t").collect()}
    want = {(a, b): ratio(a, b) for a in titles for b in titles if a != b and SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert got == want and len(want) > 20


def test_redundant_texts(spark):
    texts = ["run the test again", "run the test", "Again the TEST run", "", None, "write a plan", "write the plan", "a plan write", "see a doctor"]
    rows = list(enumerate(texts))
    seen = ["see the doctor", "Run"]
    words = lambda t: set((t or "").lower().split())
    alike = lambda a, b: bool(words(a) | words(b)) and bool(words(a)) and len(words(a) & words(b)) / len(words(a) | words(b)) >= 0.5
    df = spark.createDataFrame(rows, "id long, text string")
    for old in (None, seen):
        left = [r for r in rows if not any(alike(r[1], t) for t in old or [])]
        want = {i[0]: (by is None, None if by is None else by[0]) for i, by in s.first_of_all(left, lambda a, b: alike(a[1], b[1]))} | {r[0]: (False, None) for r in rows if r not in left}
        told = s.redundancy_filter(df, "id", F.col("text"), 0.5, None if old is None else spark.createDataFrame([(t,) for t in old], "text string"))
        assert {r.id: (r.kept, r.matched) for r in told.collect()} == want


def test_page_titles_one_by_one(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", F.regexp_extract("url", "^[^?]+", 0), F.lit(None).cast("string"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).orderBy("page_id").collect()
    want = [(i, k, "address" if m == "doi" else m, i if b is None else b) for i, k, m, b in one_by_one(list(map(tuple, pages)))]
    got = registry.queries()["fuzzy_title_dedup"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, doi string, title string")
    assert s.multi_key_dedup(df, "id", {"doi": F.col("doi")}, F.col("title")).count() == 0
    assert s.redundancy_filter(df, "id", F.col("title"), 0.5).count() == 0
