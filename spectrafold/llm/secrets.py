"""Secret scan: fixed patterns plus a battery of randomness tests, in DataFrame functions only.

Base spans are the contract's three patterns.  The method adds ``random``
spans: runs of 20 or more characters, however long, that look drawn at random.
The smallest alphabet that holds a run is its encoding (digits, hex, one case,
base 32, letters, letters and digits, base 64), and statistics of the run are
compared with what ordinary text would give:

* chi-squared uniformity over the encoding's alphabet,
* runs of character kinds (lower case, capital, digit) and of vowels and
  consonants,
* serial correlation of the code points.

What ordinary text gives is fitted from the corpus: all its runs below 20
characters are counted, and the frequencies of their characters, the share of
places where kinds or vowels change and their serial correlation are the null,
per encoding from the characters of its alphabet, with moments that follow from
the length.  Fixed values count as ``PRIOR_CHARS`` characters beside the corpus,
so that a small corpus claims little.  The statistics' normal scores are summed,
and scaled by the spread that the sum has over the corpus's own longer words,
which covers their dependence.  Discoveries are controlled by
Benjamini-Hochberg within strata of encoding and length, over all distinct
runs of the corpus: long runs need not pay for the many short ones.  The
step-up cut comes from a histogram of p-values per stratum, so what is gathered
is of fixed size; runs are counted once however often they occur.

Runs of digits only are tested like all others; where the corpus's own numbers
use digits evenly they differ from these in nothing the battery sees.

Defined results: null and empty texts have no spans; ties are ordered by start
and kind; repeated rows each get a row; an empty table gives an empty result;
very long runs are summed up in pieces of 4,096 characters; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spectrafold.llm._spans import SPAN, listed, said, spans
from spectrafold.llm._store import Scratch

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Shorter runs carry too little evidence, and are the ordinary text that the null is fitted to.
LEAST = 20
RUN = r"[A-Za-z0-9+/_=-]+"
RANDOM = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Ordinary words that show how far the summed scores spread.
LONG_WORD = 12
KINDS = ["assign", "access", "hex", "random"]
FALSE_DISCOVERY = 0.01
#: Characters of corpus that the fixed values below weigh.
PRIOR_CHARS = 100_000
#: Share of places where the kind changes, where vowels and consonants do, and serial correlation.
PRIOR_RATES = {"kind": 0.1, "vowel": 0.6, "serial": 0.1}
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet on: its pattern and characters.
ENCODINGS = {
    "digits": ("[0-9]+", _DIGITS),
    "hex": ("[0-9a-f]+", _DIGITS + "abcdef"),
    "capital hex": ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    "lower": ("[a-z]+", _LOWER),
    "upper": ("[A-Z]+", _UPPER),
    "base32": ("[A-Z2-7]+=*", _UPPER + "234567"),
    "lower alnum": ("[a-z0-9]+", _LOWER + _DIGITS),
    "upper alnum": ("[A-Z0-9]+", _UPPER + _DIGITS),
    "letters": ("[A-Za-z]+", _LOWER + _UPPER),
    "alnum": ("[A-Za-z0-9]+", _LOWER + _UPPER + _DIGITS),
    "base64": (".+", _LOWER + _UPPER + _DIGITS + "+/-_="),
}
_ALL = ENCODINGS["base64"][1]
#: Histogram cells of -log10(p), and the strata of length.
_CELLS = 160


def base_spans(text: Column) -> dict[str, Column]:
    """The contract's spans by kind. The prefilter of each pattern is the pattern itself."""
    assign = F.filter(spans(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 1)) >= 8)
    access = F.filter(spans(text, ACCESS), lambda m: F.length(m["text"]) >= 16)
    # Runs of hex digits are everywhere in prose; only texts with a long one are split.
    hexes = F.when(text.rlike(r"[0-9a-f]{32}"), F.filter(spans(text, HEX), lambda m: F.length(m["text"]) >= 32)).otherwise(F.array().cast(SPAN))
    return {"assign": assign, "access": access, "hex": hexes}


def _serial(token: Column) -> Column:
    """Lag-one correlation of the code points from sums over pieces."""
    names = ("n", "x", "xx", "m", "ends", "xy")
    zero = F.struct(*[F.lit(0.0).alias(c) for c in names])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)

    def add(acc: Column, piece: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(piece, F.lit("."), F.lit(0)), lambda c: F.ascii(c).cast("double"))
        sums = F.transform(F.array(codes), lambda x: F.struct(
            F.size(x).cast("double").alias("n"), total(x).alias("x"), total(F.transform(x, lambda v: v * v)).alias("xx"), (F.size(x) - 1).cast("double").alias("m"), (x[0] + F.element_at(x, -1)).alias("ends"),
            total(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda v, w: v * w)).alias("xy"),
        ))[0]
        return F.transform(F.array(sums), lambda t: F.struct(*[(acc[c] + t[c]).alias(c) for c in names]))[0]

    def told(acc: Column) -> Column:
        mean = acc["x"] / acc["n"]
        spread = acc["xx"] / acc["n"] - mean * mean
        return F.when(spread > 1e-9, (acc["xy"] - mean * (2 * acc["x"] - acc["ends"]) + acc["m"] * mean * mean) / (spread * acc["n"])).otherwise(1.0)

    return F.aggregate(F.regexp_extract_all(token, F.lit(".{1,4096}"), F.lit(0)), zero, add, told)


def _statistics(tokens: DataFrame) -> DataFrame:
    """``tokens`` with places and changes of kinds and of vowels; separators of slugs and paths are no evidence of chance and are left out."""
    kinds = F.translate("token", _ALL, "l" * 26 + "u" * 26 + "d" * 10)
    vowels = "".join("v" if c in "aeiou" else "c" for c in _LOWER)
    voices = F.translate("token", _LOWER + _UPPER + _DIGITS + "+/-_=", vowels * 2)
    changes = lambda said, runs: F.greatest(F.regexp_count(said, F.lit(runs)) - 1, F.lit(0)).cast("double")
    places = lambda said: F.greatest(F.length(said) - 1, F.lit(0)).cast("double")
    out = tokens.withColumn("kinds", kinds).withColumn("voices", voices).withColumn("n", F.length("token").cast("double"))
    out = out.withColumn("kind_places", places(F.col("kinds"))).withColumn("kind_changes", changes(F.col("kinds"), "l+|u+|d+"))
    return out.withColumn("vowel_places", places(F.col("voices"))).withColumn("vowel_changes", changes(F.col("voices"), "v+|c+")).drop("kinds", "voices")


def fit_null(words: DataFrame) -> dict:
    """What ordinary text gives, from ``words(token, times)``: one row of sums and one a character, whatever the corpus.

    ``moments`` has by encoding the sums of squared and of cubed frequencies.
    """
    weigh = lambda c: F.coalesce(F.sum(c * F.col("times")), F.lit(0.0)).cast("double")
    long = F.col("n") >= LONG_WORD
    told = _statistics(words).agg(
        *[weigh(F.col(c)).alias(c) for c in ("kind_places", "kind_changes", "vowel_places", "vowel_changes")],
        F.count(F.when(long, 1)).alias("long"), F.coalesce(F.sum(F.when(long, _serial(F.col("token")) + 1 / F.col("n"))), F.lit(0.0)).alias("serial"),
    ).first()
    letters = words.select(F.explode(F.regexp_extract_all("token", F.lit("."), F.lit(0))).alias("c"), "times").groupBy("c").agg(F.sum("times").alias("n")).collect()
    rate = lambda name, seen, of: (PRIOR_RATES[name] * PRIOR_CHARS + seen) / (PRIOR_CHARS + of)
    null = {"kind": rate("kind", told["kind_changes"], told["kind_places"]), "vowel": rate("vowel", told["vowel_changes"], told["vowel_places"])}
    null["serial"] = rate("serial", told["serial"] * LONG_WORD, told["long"] * LONG_WORD)
    seen, null["moments"] = dict.fromkeys(_ALL, 0) | {r["c"]: r["n"] for r in letters}, {}
    for name, (_, alphabet) in ENCODINGS.items():
        # Ordinary text is this much less even than the alphabet.
        k, uneven = len(alphabet), 2.2 if len(alphabet) <= 16 else 3.0 if len(alphabet) <= 36 else 5.5
        size = sum(seen[c] for c in alphabet)
        own = PRIOR_CHARS / (PRIOR_CHARS + size)
        moment = lambda e: sum((seen[c] / size) ** e for c in alphabet) if size else 0.0
        q2 = own * uneven / k + (1 - own) * moment(2)
        null["moments"][name] = (q2, max(own * 1.2 * (uneven / k) ** 2 + (1 - own) * moment(3), q2 * q2))
    return null


def _scores(tokens: DataFrame, null: dict) -> DataFrame:
    """Runs with ``encoding``, ``n`` and ``z``, the sum of their scores under the null, larger where they look more random."""
    encoding = F.coalesce(*[F.when(F.col("token").rlike(f"^{pattern}$"), F.lit(name)) for name, (pattern, _) in ENCODINGS.items()])
    squares = F.aggregate(F.array(*map(F.lit, _ALL)), F.lit(0.0), lambda s, c: s + F.pow((F.length("token") - F.length(F.replace("token", c, F.lit("")))).cast("double"), F.lit(2.0)))
    moments = F.create_map(*[x for name, m in null["moments"].items() for x in (F.lit(name), F.struct(F.lit(float(m[0])).alias("q2"), F.lit(float(m[1])).alias("q3")))])
    counted = ["n", "kind_places", "kind_changes", "vowel_places", "vowel_changes"]
    known = _statistics(tokens).withColumn("seen", F.struct(*counted, encoding.alias("encoding"), squares.alias("squares"), _serial(F.col("token")).alias("serial")))
    # Bound as the only element of an array, so that each statistic is computed once.
    seen = F.transform(F.array("seen"), lambda t: F.struct(t.alias("t"), F.element_at(moments, t["encoding"]).alias("m")))

    def score(u: Column) -> Column:
        t, n, q2, q3 = u["t"], u["t"]["n"], u["m"]["q2"], u["m"]["q3"]
        # Chi-squared is k * squares / n - n, so both are compared alike; moments of the squares of multinomial counts.
        spread = 4 * n * (n - 1) * (n - 2) * F.greatest(q3 - q2 * q2, F.lit(0.0)) + 2 * n * (n - 1) * (q2 - q2 * q2)
        chi = (n + n * (n - 1) * q2 - t["squares"]) / F.sqrt(spread)
        changed = lambda what: (t[f"{what}_changes"] - null[what] * t[f"{what}_places"]) / F.sqrt(t[f"{what}_places"] * (null[what] * (1 - null[what])))
        # Kinds of one-case runs and of digits never change, and tell nothing.
        kind = (t["kind_places"] > 0) & ~t["encoding"].isin("digits", "lower", "upper")
        vowel = t["vowel_places"] > 0
        serial = (1.0 if null["serial"] < 0 else -1.0) * (t["serial"] + 1 / n - null["serial"]) * F.sqrt(n)
        total = chi + F.when(kind, changed("kind")).otherwise(0.0) - F.when(vowel, changed("vowel")).otherwise(0.0) + 0.5 * serial
        return F.struct(t["encoding"].alias("encoding"), n.alias("n"), (total / F.sqrt(1.25 + kind.cast("double") + vowel.cast("double"))).alias("z"))

    return known.select(*tokens.columns, F.transform(seen, score)[0].alias("said")).select(*tokens.columns, "said.*")


def _battery(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct runs with their encoding, stratum and -log10 of the p-value under ordinary text."""
    null = fit_null(words)
    longer = _scores(words.where(F.length("token") >= LONG_WORD).where(F.col("token").rlike("^[A-Za-z]+$")), null)
    # Words weigh alike; the fixed value of 1 weighs as many as hold its characters.
    told = longer.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("z") * F.col("z")), F.lit(0.0)).alias("zz")).first()
    prior = PRIOR_CHARS / LONG_WORD
    scale = max(1.0, (prior + told["zz"]) / (prior + told["n"])) ** 0.5
    known = _scores(tokens, null)
    # Tail of the standard normal by a continued-fraction bound, on a log10 scale.
    x = F.greatest(F.col("z") / scale, F.lit(0.0))
    evidence = (x * x / 2 + F.log(x + F.sqrt(x * x + 4)) + F.lit(0.2257913526447274 - 0.6931471805599453)) / F.lit(2.302585092994046)
    stratum = F.concat_ws("-", "encoding", F.floor(F.log2("n")).cast("string"))
    return known.select("token", "encoding", stratum.alias("stratum"), F.greatest(evidence, F.lit(0.0)).alias("evidence"))


def random_tokens(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct runs of ``texts(token)`` that pass the battery at the set rate of false discoveries; ``words(token, times)`` are the corpus's shorter runs."""
    tested = _battery(texts.distinct(), words)
    cell = F.least(F.floor(F.col("evidence") * 10), F.lit(_CELLS)).cast("int")
    counts = tested.groupBy("stratum", cell.alias("cell")).agg(F.count("*").alias("n"))
    # A stratum has at most _CELLS + 1 rows here, whatever the corpus.
    down = W.partitionBy("stratum").orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)
    steps = counts.withColumn("above", F.sum("n").over(down)).withColumn("all", F.sum("n").over(W.partitionBy("stratum")))
    passed = steps.where(F.pow(F.lit(10.0), -F.col("cell") / 10) * F.col("all") <= FALSE_DISCOVERY * F.col("above"))
    cuts = passed.groupBy("stratum").agg(F.min("cell").alias("cut"))
    return tested.withColumn("cell", cell).join(F.broadcast(cuts), "stratum").where("cell >= cut").select("token", "encoding", "evidence")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, base spans by kind (``assign``, ``access``, ``hex``) and ``random`` spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    base = base_spans(F.col("text"))
    found = rows.select(id_col, "row", *[c.alias(k) for k, c in base.items()], spans(F.col("text"), RANDOM).alias("candidates"))
    # Only rows with candidates enter the joins; they are written once so that both uses see the same rows.
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.put(found, "found")
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("token")).where(F.length("token") < LEAST)
    words = scratch.put(words.groupBy("token").agg(F.count("*").alias("times")), "words")
    each = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c"))
    good = random_tokens(each.select(F.col("c.text").alias("token")), words).select("token")
    hits = each.join(good, F.col("c.text") == F.col("token"), "left_semi").groupBy("row").agg(F.array_sort(F.collect_list("c")).alias("random"))
    out = found.join(hits, "row", "left")
    return out.select(id_col, *base, F.coalesce("random", F.array().cast(SPAN)).alias("random"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = listed({k: F.col(k) for k in KINDS[:3]})
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(said(base, KINDS), 256).alias("base_sha256"),
        said(listed({k: F.col(k) for k in KINDS}), KINDS).alias("spans"),
    )


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by Python's regular expressions, for tests."""
    import re

    text = text or ""
    out = []
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]
