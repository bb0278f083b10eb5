"""How filters interact: every order of the filters, from counts of failure masks.

A document's failures are a mask of five bits.  Whatever the order of the
filters, what happens to a document depends on its mask alone, so documents are
counted by part and mask first (at most 32 cells for a part), with those
of good quality and those that are toxic.  Each cell then folds across the array
of orders, a constant that every task gets: ``transform`` walks the orders,
``aggregate`` the letters of one order, carrying whether the cell's documents
are still there.  That gives 600 structs a cell (120 orders of 5 steps),
weighted by the cell's counts, and the cells of a part merge by elementwise
sums.

Texts are read once, by a map with DataFrame functions.  Only ids, digests and
counts are shuffled.  Whether a text occurs under a smaller id is
decided for all rows of one SHA-256 digest: rows are counted by digest, part and
mask before they meet, so a text that a third of all rows share is a few rows.

Failures: A fewer than 200 words; B distinct words below half of the words; C
more than 3 % of the code points are ``[A-Z]``; D holds one of ``#$%&*|``; E the
text occurs under a smaller id.

Defined results: a null text is empty and fails A (and E where an empty text has a
smaller id); a null lang is the part ``''``; rows without id neither fail E nor
make others fail it; rows that share an id and a text count each and don't make
each other fail; a document is of good quality or toxic if any label row of its
id says 1; rows without label are neither; other columns are not read; an
empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 200
_SPACE = "[ \\t\\n\\x0B\\f\\r]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def failures(text: Column) -> Column:
    """Bits A to D (1, 2, 4, 8) of a text that is not null."""
    trimmed = F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_SPACE}+"))
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    of = F.get(counted, F.lit(0))
    bits = F.transform(
        F.array(of),
        lambda w: F.when(w["n"] < MIN_WORDS, 1).otherwise(0)
        + F.when(100 * w["distinct"] < 50 * w["n"], 2).otherwise(0)
        + F.when(100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text), 4).otherwise(0)
        + F.when(F.rlike(text, F.lit("[#$%&*|]")), 8).otherwise(0),
    )
    return F.get(bits, F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Cells: part, mask (bits A to E), n, good, toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), failures(F.col("text")).alias("mask"))
    said = labels.select(F.col("doc_id").alias("id"), F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("toxic"))
    said = said.where("id IS NOT NULL AND (good OR toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    by = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.join(said, "id", "left").fillna(False, ["good", "toxic"]).groupBy("id", *by).agg(F.count("*").alias("n"))
    # Rows of one digest that differ in nothing else but the id: how many, the least id and the rows that have it.
    met = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    least = met.groupBy("digest").agg(F.min("least").alias("all_least"))
    met = met.join(least, "digest")
    stay = F.when(F.col("least") == F.col("all_least"), F.col("first")).otherwise(0) + F.col("unknown")
    cells = met.select("part", "mask", "good", "toxic", stay.alias("stay"), (F.col("n") - stay).alias("repeats"))
    cells = cells.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("repeats").alias("n")))))
    one = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), one("good"), one("toxic"))


def _steps(order: Column, mask: Column, weights: dict[str, Column], filters: str) -> Column:
    """The steps of one order for one cell, as structs of ``COUNTS``; the fold carries whether the documents are still there."""
    zero = F.lit(0).cast("long")
    kind = "struct<here:boolean,steps:array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>>"

    def step(state: Column, letter: Column) -> Column:
        bit = F.expr("0")
        for k, name in enumerate(filters):
            bit = F.when(letter == name, 1 << k).otherwise(bit)
        fails, here = mask.bitwiseAND(bit) != 0, state["here"]
        counts = F.struct(
            F.when(here & ~fails, weights["n"]).otherwise(zero).alias("kept"),
            F.when(here & fails, weights["n"]).otherwise(zero).alias("removed"),
            F.when(~here & fails, weights["n"]).otherwise(zero).alias("redundant"),
            F.when(mask == bit, weights["n"]).otherwise(zero).alias("unique_fails"),
            F.when(here & fails, weights["good"]).otherwise(zero).alias("good_lost"),
            F.when(here & fails, weights["toxic"]).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct((here & ~fails).alias("here"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    start = F.struct(F.lit(True).alias("here"), F.array().alias("steps")).cast(kind)
    return F.aggregate(F.split(order, ""), start, step, lambda state: state["steps"])


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, filter_order and step from ``cells(part, mask, n, good, toxic)``."""
    names = orders(filters)
    every = F.array(*[F.lit(o) for o in names])
    weights = {c: F.col(c) for c in ("n", "good", "toxic")}
    folded = cells.select("part", F.flatten(F.transform(every, lambda o: _steps(o, F.col("mask"), weights, filters))).alias("steps"))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    merge = lambda done, cell: F.zip_with(done, cell, add)
    # At most 2 ** len(filters) cells meet for a part.
    met = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    met = met.select("part", F.aggregate(F.slice("cells", 2, 1 << len(filters)), F.get("cells", F.lit(0)), merge).alias("steps"))
    rows = met.select("part", F.posexplode("steps").alias("at", "counts")).select("part", "at", "counts.*")
    letters = F.array(*[F.lit(o) for o in names])
    n = len(filters)
    rows = rows.withColumns({"filter_order": F.get(letters, F.floor(F.col("at") / n).cast("int")), "step": (F.col("at") % n + 1).cast("int")})
    rows = rows.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    share = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(share, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, t, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, coalesce(sum(good::INT), 0) AS good, coalesce(sum(toxic::INT), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)),
p AS (SELECT k1.letter || k2.letter || k3.letter || k4.letter || k5.letter AS filter_order, [k1.bit, k2.bit, k3.bit, k4.bit, k5.bit] AS bits
  FROM k k1, k k2, k k3, k k4, k k5 WHERE k1.bit + k2.bit + k3.bit + k4.bit + k5.bit = 31 AND len(list_distinct([k1.bit, k2.bit, k3.bit, k4.bit, k5.bit])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM p, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM g
"""


def brute_force(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """The contract read literally, for tests: rows of (id, text, lang) and (id, quality, toxic)."""
    import re

    def fails(i, t):
        words = re.findall("[^\x20\x09-\x0d]+", t)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }

    said = {i: (any(q == 1 for j, q, _ in labels if j == i), any(x == 1 for j, _, x in labels if j == i)) for i in {d[0] for d in docs} if i is not None}
    all_fails = [fails(i, t or "") for i, t, _ in docs]
    out = []
    for part in {lang or "" for _, _, lang in docs}:
        own = [(f, *said.get(i, (False, False))) for f, (i, _, lang) in zip(all_fails, docs) if (lang or "") == part]
        rows, shapley = [], dict.fromkeys(FILTERS, 0)
        for order in orders():
            left = own
            for k, x in enumerate(order):
                gone = [d for d in left if d[0][x]]
                kept = [d for d in left if not d[0][x]]
                failing = [d for d in own if d[0][x]]
                only = [d for d in failing if sum(d[0].values()) == 1]
                rows.append((part, order, k + 1, len(kept), len(gone), len(failing) - len(gone), len(only), sum(d[1] for d in gone), sum(d[2] for d in gone)))
                shapley[x] += len(gone)
                left = kept
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)
