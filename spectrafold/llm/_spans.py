"""Spans of regular-expression matches as column expressions, without Python workers.

Spark gives the matched strings and the pieces between matches, but no places;
places follow from the running lengths of both.  Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"


#: Matches whose places are summed up apart before the parts are joined.
PART = 128


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, text>>`` (end exclusive).

    The pattern may not match empty strings.  Texts without a match cost one
    scan.  Places are running sums, made in parts of ``PART`` matches so that a
    text of very many matches doesn't copy its list once for each.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    def joined(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["text"].alias("text")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    # The pairs are bound once, as the only element of an array, and cut from there.
    parts = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / PART).cast("int")), lambda k: F.aggregate(F.slice(p, k * PART + 1, F.lit(PART)), start, one)))
    return F.when(text.rlike(pattern), F.aggregate(parts[0], start, joined, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def listed(kinds: dict[str, Column]) -> Column:
    """Spans of all kinds as ``array<struct<start, kind_no, end>>`` in order of start, then kind as listed."""

    def numbered(i: int):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"))

    return F.array_sort(F.concat(*[F.transform(s, numbered(i)) for i, s in enumerate(kinds.values())]))


def said(spans_col: Column, names: list[str]) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
