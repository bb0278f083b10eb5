"""Scores and labels of rows as column expressions: texts, evidence, plans, names.

Weights and cut-offs are parameters; every score stays in whole-stage code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def pattern_score(text: Column, weights: Mapping[str, float], start: float = 0.5) -> Column:
    """``start`` plus the weight of every pattern the text matches, clipped to [0, 1]."""
    return clipped(total([F.lit(start), *[F.when(F.lower(text).rlike(p), w).otherwise(0.0) for p, w in weights.items()]]))


def lexicon_hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    low = F.lower(text)
    return total([F.contains(low, F.lit(w)).cast("int") for w in words])


def claim_strength(text: Column, strong: Sequence[str], hedged: Sequence[str], neutral: float = 0.4) -> Column:
    """Strong words among strong and hedging ones; a bonus for three strong ones without a hedge."""
    s, h = lexicon_hits(text, strong), lexicon_hits(text, hedged)
    return F.when(s + h == 0, neutral).otherwise(F.least(s / (s + h) + F.when((s >= 3) & (h == 0), 0.2).otherwise(0.0), F.lit(1.0)))


def keyword_domain(text: Column, domains: Mapping[str, Sequence[str]]) -> Column:
    """Struct of the best domain by share of its keywords found (ties to the first named), its score, and others over 0.3."""
    scores = [F.struct((lexicon_hits(text, words) / float(len(words))).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(domains.items())]
    best = F.array_max(F.array(*scores))
    more = F.array_sort(F.transform(F.filter(F.array(*scores), lambda s: (s["score"] > 0.3) & (s["name"] != best["name"])), lambda s: s["name"]))
    return F.struct(F.when(best["score"] > 0, best["name"]).alias("domain"), best["score"].alias("score"), more.alias("secondary"))


def checklist(checks: Sequence[Column]) -> Column:
    """Share of checks met."""
    return total([F.coalesce(c, F.lit(False)).cast("int") for c in checks]) / float(len(checks))


def penalised(errors: Column, warnings: Column, bonuses: Sequence[Column] = (), per_error: float = 0.15, per_warning: float = 0.05, bonus: float = 0.05) -> Column:
    return clipped(total([F.lit(1.0) - per_error * errors - per_warning * warnings, *[F.when(b, bonus).otherwise(0.0) for b in bonuses]]))


def tiered_penalty(value: Column, tiers: Sequence[tuple[float, float]]) -> Column:
    """The penalty of the highest tier that the value exceeds; tiers are given from high to low."""
    out = None
    for limit, penalty in tiers:
        out = F.when(value > limit, penalty) if out is None else out.when(value > limit, penalty)
    return out.otherwise(0.0)


def weighted(scores: Mapping[str, float], missing: float = 0.5) -> Column:
    """Weighted mean of columns, a missing one counted as ``missing``."""
    return total([F.coalesce(F.col(c), F.lit(missing)) * w for c, w in scores.items()]) / sum(scores.values())


def evidence_strength(p: Column, effect: Column, n: Column) -> Column:
    """Binned strength of p, effect and sample size, with the weights of those present brought to one."""
    parts = [
        (0.4, F.when(p < 0.001, 1.0).when(p < 0.01, 0.8).when(p < 0.05, 0.6).when(p.isNotNull(), 0.2)),
        (0.4, F.when(F.abs(effect) >= 0.8, 1.0).when(F.abs(effect) >= 0.5, 0.7).when(F.abs(effect) >= 0.2, 0.4).when(effect.isNotNull(), 0.1)),
        (0.2, F.when(n >= 100, 1.0).when(n >= 30, 0.6).when(n.isNotNull(), 0.3)),
    ]
    top = total([F.coalesce(s * w, F.lit(0.0)) for w, s in parts])
    mass = total([F.when(s.isNotNull(), w).otherwise(0.0) for w, s in parts])
    return F.when(mass > 0, top / mass).otherwise(0.0)


def support(p: Column, effect: Column) -> Column:
    """Whether a result supports its claim: significant and not tiny; NULL without p."""
    return F.when(p.isNotNull(), (p < 0.05) & (F.abs(effect) > 0.2))


def same_sign(columns: Sequence[Column]) -> Column:
    """Whether at least two values are known and all of them lie on one side of zero."""
    known = F.array_compact(F.array(*columns))
    signs = F.array_distinct(F.transform(known, lambda v: F.signum(v)))
    return (F.size(known) >= 2) & (F.size(signs) == 1) & (F.element_at(signs, 1) != 0)


def direction(value: Column) -> Column:
    return F.when(value > 0, "increases").when(value < 0, "decreases").otherwise("none")


def composite(p: Column, beta: Column, posterior: Column, flags: Sequence[Column]) -> Column:
    """Points for the strength of an association, its size and posterior, and five for each further line of evidence; at most 55."""
    points = F.when(p < 5e-8, 10).when(p < 1e-5, 7).when(p < 1e-3, 4).otherwise(0) + F.when(F.abs(beta) > 0.3, 5).when(F.abs(beta) > 0.1, 3).otherwise(0) + F.floor(F.coalesce(posterior, F.lit(0.0)) * 10)
    return F.least(total([points, *[F.when(F.coalesce(f, F.lit(False)), 5).otherwise(0) for f in flags]]), F.lit(55)).cast("int")


def level(score: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first cut-off reached, given from high to low."""
    out = None
    for cut, label in cuts:
        out = F.when(score >= cut, label) if out is None else out.when(score >= cut, label)
    return out.otherwise(rest)


def volcano(p: Column, change: Column, alpha: float = 0.05, least: float = 1.0) -> Column:
    """Struct of -log10 p (100 where p is 0) and the class of a point."""
    height = F.when(p <= 0, 100.0).otherwise(-F.log10(p))
    return F.struct(height.alias("height"), F.when((p < alpha) & (change >= least), "up").when((p < alpha) & (change <= -least), "down").otherwise("ns").alias("class"))


def name_class(name: Column, exact: Mapping[str, Sequence[str]], suffixes: Mapping[str, Sequence[str]], parts: Mapping[str, Sequence[str]], rest: str = "other") -> Column:
    """A kind by the name itself, then by its ending, then by what it contains."""
    low = F.trim(F.lower(name))
    out = None
    for kinds, test in ((exact, lambda w: low == w), (suffixes, lambda w: F.endswith(low, F.lit(w))), (parts, lambda w: F.contains(low, F.lit(w)))):
        for kind, words in kinds.items():
            hit = reduce(lambda a, b: a | b, [test(w) for w in words])
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(rest)


def token_set(text: Column, least: int = 1, stop: Sequence[str] = ()) -> Column:
    """Distinct lower-case words of at least ``least`` letters without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z]{{{least},}}"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def novelty(similarity: Column) -> Column:
    """How new something is by its greatest similarity to what is known: none above 0.9, all below 0.3."""
    return F.when(similarity >= 0.9, 0.0).when(similarity < 0.3, 1.0).otherwise(1 - (similarity - 0.3) / 0.6)


def blended(text: Column, numbers: Column, kind: Column) -> Column:
    return 0.6 * text + 0.3 * numbers + 0.1 * kind.cast("double")


def result_similarity(e1: Column, e2: Column, p1: Column, p2: Column) -> Column:
    """Agreement of two results: sign and size of effect, and significance; 0.5 where nothing is known."""
    size = F.when(F.signum(e1) != F.signum(e2), 0.0).otherwise(F.least(F.abs(e1), F.abs(e2)) / F.greatest(F.abs(e1), F.abs(e2), F.lit(1e-12)))
    known = F.array_compact(F.array(size, ((p1 < 0.05) == (p2 < 0.05)).cast("double")))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.5)


def numbers_in(text: Column) -> Column:
    """Struct of the least p, strongest r and greatest n that a text reports."""
    got = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("double"))
    r = got(r"(?i)\br\s*=\s*(-?[0-9]*\.?[0-9]+)")
    return F.struct(F.array_min(got(r"(?i)\bp\s*[=<]\s*([0-9]*\.?[0-9]+)")).alias("min_p"), F.array_max(F.transform(r, lambda x: F.abs(x))).alias("max_r"), F.array_max(got(r"(?i)\bn\s*=\s*([0-9]+)")).alias("max_n"))


def head_and_tail(text: Column, most: int) -> Column:
    """The text, or its two ends with a mark between where it is longer than ``most``."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.substring(text, -half, half)))


def citations_in(text: Column) -> Column:
    """Distinct author-year, numbered and DOI citations of a text, sorted."""
    named = F.regexp_extract_all(text, F.lit(r"\(([A-Z][A-Za-z]+(?: et al\.)?,? [0-9]{4})\)"), F.lit(1))
    numbered = F.regexp_extract_all(text, F.lit(r"\[([0-9]+(?:, ?[0-9]+)*)\]"), F.lit(1))
    doi = F.regexp_extract_all(text, F.lit(r"(10\.[0-9]{4,}/[^\s)\]]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(named, numbered, doi)))


def clean_text(text: Column) -> Column:
    """Words broken at line ends joined, single line ends to blanks, runs of blanks and of empty lines shortened."""
    out = F.regexp_replace(text, r"(\p{L})-\n(\p{L})", "$1$2")
    out = F.regexp_replace(out, r"(?<!\n)\n(?!\n)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def parsed_json(text: Column, schema: str) -> Column:
    """The first JSON object of a text."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def keywords(text: Column, stop: Sequence[str], most: int) -> Column:
    """Distinct content words, longest first, ties in alphabetical order."""
    words = token_set(text, 3, stop)
    return F.slice(F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"]), 1, most)


def article_id(text: Column) -> Column:
    """An archive id without prefix and version."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^(https?://[^/]+/(abs|pdf)/|arXiv:)", ""), r"(v[0-9]+)?(\.pdf)?$", "")


def cache_key(fields: Mapping[str, Column]) -> Column:
    """A digest of named values, whatever their order; numbers are rounded to six places."""
    named = [F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit("null"))) for n, c in sorted(fields.items())]
    return F.sha2(F.concat_ws("&", *named), 256)


def relevance(citations: Column, title_overlap: Column, abstract_overlap: Column, year: Column, now: int) -> Column:
    """Citations (capped), overlap with the query, and newness within five years."""
    age = F.lit(now) - year
    return F.least(citations / 10.0, F.lit(100.0)) + 50 * title_overlap + 30 * abstract_overlap + F.when(age <= 5, 4.0 * (5 - age)).otherwise(0.0)


def weighted_relevance(cosine: Column, citations: Column, year: Column, now: int) -> Column:
    return 0.4 * cosine + 0.3 * F.least(F.log1p(citations) / F.log1p(F.lit(1000.0)), F.lit(1.0)) + 0.2 * F.greatest(F.lit(0.0), 1 - (F.lit(now) - year) / 5.0)


def resources(base: Column, complexity: Column, steps: Column, samples: Column) -> Column:
    """Estimated effort: a base by kind, times complexity, steps (within 0.5 to 3) and sample size."""
    return base * complexity * clipped(steps / 5.0, 0.5, 3.0) * F.when(samples > 10000, 2.0).when(samples > 1000, 1.5).otherwise(1.0)


def format_size(size: Column) -> Column:
    """Bytes in the largest unit of which there is at least one."""
    out = None
    for power, unit in ((4, "T"), (3, "G"), (2, "M"), (1, "K")):
        test, said = size >= 1024**power, F.concat(F.round(size / float(1024**power), 1).cast("decimal(20,1)").cast("string"), F.lit(unit))
        out = F.when(test, said) if out is None else out.when(test, said)
    return out.otherwise(F.concat(size.cast("string"), F.lit("B")))


def casing(names: Column) -> Column:
    """The style of an array of names: at least 60 % in upper or in title case."""
    share = lambda p: F.size(F.filter(names, lambda n: n.rlike(p))) / F.size(names)
    return F.when(F.size(names) == 0, "none").when(share("^[A-Z0-9-]+$") >= 0.6, "upper").when(share("^[A-Z][a-z0-9-]+$") >= 0.6, "title").otherwise("mixed")


def decide(rules: Sequence[tuple[Column, str]], rest: str) -> Column:
    """The decision of the first rule met."""
    out = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(rest)


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """All reasons that apply, joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in rules])), "; ")


def missing_fields(fields: Sequence[str]) -> Column:
    """Names of fields that are missing or empty."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields]))


def bibtex(kind: Column, key: Column, fields: Mapping[str, Column]) -> Column:
    """An entry with the fields that have a value."""
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), c.cast("string"), F.lit("}"))) for n, c in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def ris(kind: Column, fields: Mapping[str, Column], authors: Column | None = None) -> Column:
    lines = [F.concat(F.lit("TY  - "), kind)]
    if authors is not None:
        lines.append(F.array_join(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)), "\n"))
    lines += [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}  - "), c.cast("string"))) for n, c in fields.items()]
    return F.concat_ws("\n", *lines, F.lit("ER  - "))


def citation(style: str, author: Column, year: Column, title: Column, place: Column) -> Column:
    """One line in the style named."""
    y = year.cast("string")
    parts = {
        "apa": [author, F.lit(" ("), y, F.lit("). "), title, F.lit(". "), place, F.lit(".")],
        "chicago": [author, F.lit('. "'), title, F.lit('." '), place, F.lit(" ("), y, F.lit(").")],
        "ieee": [author, F.lit(', "'), title, F.lit('," '), place, F.lit(", "), y, F.lit(".")],
        "harvard": [author, F.lit(" "), y, F.lit(", '"), title, F.lit("', "), place, F.lit(".")],
        "vancouver": [author, F.lit(". "), title, F.lit(". "), place, F.lit(". "), y, F.lit(".")],
    }
    return F.concat(*parts[style])
