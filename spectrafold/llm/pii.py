"""Personal data: fixed patterns and information-theoretic sanitisation, in DataFrame functions only.

Base spans are the contract's four patterns.  The method adds ``term`` spans:
a word discloses a protected entity (an e-mail address, phone, card or network
address found in the corpus) when

* it stands within ``REACH`` characters of the entity in at least ``SUPPORT``
  different contexts,
* of all documents that hold the word, at least ``SHARE`` hold the entity, and
* the pointwise mutual information of word and entity over documents is at
  least ``BITS``.

Words that exceed all three are marked wherever they occur in the corpus, and
:func:`sanitise` generalises base spans to their kind and removes such words.

Counts cover all documents and are combined before they are shuffled; equal
contexts count once, so copies of a page don't make a disclosure.  Candidate
words are broadcast only below a counted bound, else joined by a shuffle.

Defined results: null and empty texts have no spans; overlapping kinds are all
reported, ordered by start and kind; repeated rows each get a row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._spans import SPAN, listed, said, spans
from spectrafold.llm._store import BROADCAST_ROWS, Scratch

# Possessive forms of the contract's patterns: nothing follows the repeated groups, so the matches are the same,
# and long runs need neither recursion nor a new try at each character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}{4,}"
KINDS = ["email", "ip", "card", "phone", "term"]
REACH, SUPPORT, SHARE, BITS = 60, 3, 0.5, 4.0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The contract's spans by kind."""
    octet = lambda p: (F.length(F.regexp_replace(p, '^0+', '')) <= 3) & (F.regexp_replace(p, '^0+(?=.)', '').try_cast('int') <= 255)
    ip = F.filter(spans(text, IP), lambda m: F.forall(F.split(m["text"], r"\."), octet))
    long_run = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    card = F.filter(spans(text, CARD), lambda m: F.length(_digits(m["text"])).between(14, 19) & _luhn(_digits(m["text"])))
    phone = F.filter(spans(text, PHONE), lambda m: F.length(_digits(m["text"])).between(10, 15))
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(F.array().cast(SPAN)),
        "ip": ip,
        "card": F.when(long_run, card).otherwise(F.array().cast(SPAN)),
        "phone": F.when(F.contains(text, F.lit("+")), phone).otherwise(F.array().cast(SPAN)),
    }


def _around(text: Column, span: Column) -> Column:
    """What stands beside a span, without the span."""
    left = F.greatest(span["start"] - REACH, F.lit(0))
    return F.concat(F.substring(text, left + 1, span["start"] - left), F.lit(" \n "), F.substring(text, span["end"] + 1, F.lit(REACH)))


def disclosing_terms(texts: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """``(entity, term, contexts, share, bits)`` over the thresholds.

    ``texts(key, text)`` are all documents, ``found(key, entity, around)`` the
    protected entities with their contexts.
    """
    terms = found.select("key", "entity", F.xxhash64("around").alias("context"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("around"), F.lit(WORD), F.lit(0)))).alias("term"))
    pairs = terms.groupBy("entity", "term", "context").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= SUPPORT)
    entities = found.select("key", "entity").distinct()
    by_entity = entities.groupBy("entity").agg(F.count("*").alias("with_entity"))
    pairs = scratch.put(pairs.join(by_entity, "entity"), "pairs")
    # Documents per word over the whole corpus, combined per task before the shuffle.
    words = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term"))
    wanted = pairs.select("term").distinct()
    counted = scratch.put(words.groupBy("term").agg(F.count("*").alias("with_term")), "counted")
    by_term = scratch.put(counted.join(wanted, "term", "left_semi"), "by_term")
    scratch.drop("counted")
    n_texts = texts.count()
    # A word in more documents than its entity's over SHARE can't reach that share: common words stop here.
    pairs = scratch.put(pairs.join(by_term, "term").where(F.col("with_term") * SHARE <= F.col("with_entity")), "rare_pairs")
    # Documents that hold both: only those of the entities are looked at.
    keys = scratch.put(entities.select("key").distinct(), "keys")
    few = keys.count() <= BROADCAST_ROWS // 8
    near = words.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    both = near.join(entities, "key").join(pairs.select("entity", "term"), ["entity", "term"], "left_semi").groupBy("entity", "term").agg(F.count("*").alias("with_both"))
    scored = pairs.join(both, ["entity", "term"])
    scored = scored.withColumn("share", F.col("with_both") / F.col("with_term")).withColumn("bits", F.log2(F.col("share") * n_texts / F.col("with_entity")))
    return scored.where((F.col("share") >= SHARE) & (F.col("bits") >= BITS)).select("entity", "term", "contexts", "share", "bits")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row: id, spans by kind, and the text where asked for."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Rows equal in id and text share their spans, so this key need not tell them apart.
    rows = rows.withColumn("key", F.struct(F.col(id_col).alias("id"), F.xxhash64("text").alias("sum")))
    base = base_spans(F.col("text"))
    some = F.exists(F.concat(*[F.col(k) for k in base]), lambda m: F.lit(True))
    marked = rows.select("key", "text", *[c.alias(k) for k, c in base.items()])
    entity = F.transform(F.concat(*[F.col(k) for k in base]), lambda m: F.struct(F.lower(m["text"]).alias("entity"), _around(F.col("text"), m).alias("around")))
    hits = scratch.put(marked.where(some).select("key", *base, entity.alias("entities")), "hits")
    found = hits.select("key", F.explode("entities").alias("e")).select("key", "e.entity", "e.around")
    texts = rows.select("key", "text")
    terms = scratch.put(disclosing_terms(texts, found, scratch).select("term").distinct(), "terms")
    few = terms.count() <= BROADCAST_ROWS
    words = texts.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term"))
    per_row = scratch.put(words.join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("key").agg(F.collect_set("term").alias("terms")), "per_row")
    slim = hits.drop("entities").dropDuplicates(["key"])
    extra = slim.join(per_row, "key", "full_outer")
    extra = scratch.put(extra, "extra")
    few = extra.count() <= BROADCAST_ROWS // 8
    out = rows.join(F.broadcast(extra) if few else extra, "key", "left")
    words = F.filter(spans(F.col("text"), WORD), lambda m: F.array_contains(F.col("terms"), F.lower(m["text"])))
    empty = F.array().cast(SPAN)
    return out.select(id_col, *[F.coalesce(F.col(k), empty).alias(k) for k in base], F.when(F.col("terms").isNotNull(), words).otherwise(empty).alias("term"), *(["text"] if keep_text else []))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and texts with base spans generalised to ``[KIND]`` and disclosing words removed; of overlapping spans the first counts."""
    found = find_personal_data(docs, id_col, text_col, keep_text=True)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit(""))
    text = F.aggregate(
        listed({k: F.col(k) for k in KINDS}),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(labels, s["kind"] + 1)).alias("out")),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return found.select(id_col, text.alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = listed({k: F.col(k) for k in KINDS[:4]})
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(said(base, KINDS), 256).alias("base_sha256"),
        said(listed({k: F.col(k) for k in KINDS}), KINDS).alias("spans"),
    )


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by Python's regular expressions, for tests."""
    import re

    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    for kind, (pattern, fine) in enumerate(tests):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if fine(m[0])]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]
