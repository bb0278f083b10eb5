"""N-gram Jaccard self-join by prefix filters under several global orders.

A text's set holds the hashes of its distinct 5-word shingles.  Two sets of
similarity t or more share a token among the first ``n - ceil(t n) + 1`` tokens
of each, under any global order.  Candidates are generated under one order that
puts rare tokens first, must also share a prefix token under each of two further,
independent orders, and only pairs that pass all three are verified on whole sets.

Stages, all linear in the input but for pairs that share rare tokens:

1. Sets: signature and size of each text; texts with equal sets form a class
   whose smallest id stands for it.  The same pass counts repeated tokens per
   task into a sketch of fixed size, which only steers the order (any order
   gives the same result).
2. Prefix tokens per class, once per task, with their places; tokens of a
   single class go.
3. Stars: each class is verified against one pivot, the most central class on
   most of its tokens, and components are formed; a large group of near copies
   collapses here with one pair per member.
4. Kin: a pivot that more than ``LARGE`` classes meet leads those that meet no
   pivot met by more.  Two classes of one leader p differ by what their differences from p
   differ by.  If one of them is no link of p, both must share a good part of
   their differences, so candidates are those that share a token early enough
   among the differences; tokens that all of a large group have don't count.
5. Cross pairs: of the tokens that still hold several components, pairs of
   classes in different components are verified, but for kin; links within a
   component can't change it.

Pairs whose last shared prefix token comes too late for the shared tokens
before it are dropped (the positional bound).  Pairs that remain must share
prefix tokens under the two further orders before any whole set is read.

Defined results: null texts and texts without words have an empty set and link
with nothing; a text of fewer words is one shingle; rows with the same id count
as one node; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectrafold.llm._store import Scratch, rows_of
from spectrafold.llm._text import SPACED, mix, shingle_hashes, split_words, text_chunks
from spectrafold.llm.components import connected_components

SHINGLE = 5
#: The similarity bound as a fraction of integers: intersection * 100 >= union * 80.
PERCENT = 80
_CELLS = 1 << 18
_TALLY = 2 << 20
#: Classes that meet one pivot beyond which they are compared by their differences from it; fewer meet as cross pairs.
LARGE = 64
_ORDERS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for begin, end, data, offsets in text_chunks(column):
        hashes, doc = shingle_hashes(split_words(data, offsets, SPACED), size)
        edge = np.searchsorted(doc, np.arange(end - begin + 1))
        for d in range(end - begin):
            yield np.unique(hashes[edge[d] : edge[d + 1]])


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one, two = mix(tokens + _ORDERS[1]).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(tokens ^ _ORDERS[2]))
    return int(one.view(np.int64)), int(np.uint64(two).view(np.int64))


def _prefix(n: int, percent: int) -> int:
    return n + 1 - -(-n * percent // 100)


def _first(tokens: np.ndarray, order: int, percent: int, common: np.ndarray | None = None, p: int | None = None) -> np.ndarray:
    """The prefix tokens of a set under one of the orders, or its first ``p``, in that order."""
    key = mix(tokens ^ _ORDERS[order])
    if common is not None:
        key = (key >> np.uint64(8)) | (common[(tokens & np.uint64(_CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56))
    p = _prefix(len(tokens), percent) if p is None else p
    some = np.argpartition(key, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
    return tokens[some[np.argsort(key[some])]]


def _signatures(id_col: str, size: int):
    cells_type = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, total = None, [], 0

        def tally() -> list[dict]:
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            cells, n = (cells[n > 1] & np.uint64(_CELLS - 1)).astype(np.int64), n[n > 1]
            sums = np.bincount(cells, n, minlength=1)
            some = np.flatnonzero(sums)
            return [{"cell": c, "n": int(sums[c])} for c in some.tolist()]

        def rows(ids, n, one, two, cells):
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(cells, cells_type)], names=[id_col, "n", "one", "two", "cells"])

        for batch in batches:
            kind = batch.column(0).type
            n, one, two = [], [], []
            for tokens in _sets(batch.column(1), size):
                n.append(len(tokens))
                a, b = _signature(tokens) if len(tokens) else (None, None)
                one.append(a)
                two.append(b)
                held.append(tokens)
                total += len(tokens)
            cells = [None] * len(n)
            if total >= _TALLY and cells:
                cells[0], held, total = tally(), [], 0
            yield rows(batch.column(0), n, one, two, cells)
        if total:
            yield rows(pa.nulls(1, kind), [-1], [None], [None], [tally()])

    return run


def _prefixes(common, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            tokens_out, classes, sizes = [], [], []
            for tokens in _sets(batch.column(0), size):
                if not len(tokens):
                    continue
                one = _signature(tokens)[0]
                if one in done:
                    continue
                if len(done) > 1_000_000:
                    done.clear()
                done.add(one)
                some = _first(tokens, 0, percent, common.value)
                tokens_out.append(some)
                classes.append(one)
                sizes.append((len(some), len(tokens)))
            if classes:
                p, n = np.array(sizes).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens_out).view(np.int64)), pa.array(np.repeat(np.array(classes, dtype=np.int64), p)), pa.array(np.repeat(n, p).astype(np.int32)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in p]))],
                    names=["token", "class", "n", "at"],
                )

    return run


def _whole_sets(id_col: str, size: int, percent: int):
    """Sorted tokens of each set, and 32 bits of its prefix tokens under the two further orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(np.concatenate(rows).astype(np.uint32).view(np.int32)))
        for batch in batches:
            at, held = 0, 0
            out: list[bytes] = []
            firsts: list[list[np.ndarray]] = [[], []]

            def told():
                return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(out)), pa.array(out, pa.binary()), lists(firsts[0]), lists(firsts[1])], names=[id_col, "tokens", "one", "two"])

            for k, tokens in enumerate(_sets(batch.column(1), size)):
                out.append(tokens.tobytes())
                for order in (1, 2):
                    firsts[order - 1].append(_first(tokens, order, percent) if len(tokens) else tokens)
                held += len(out[-1])
                if held > 8 << 20:
                    yield told()
                    at, out, firsts, held = k + 1, [], [[], []], 0
            if out:
                yield told()

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _verifier(percent: int):
    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
            return False
        both = _overlap(x, y)
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [linked(np.frombuffer(x[i].as_buffer(), dtype=np.uint64), np.frombuffer(y[i].as_buffer(), dtype=np.uint64)) for i in range(len(batch))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _differences(common, percent: int):
    """Of each class (a), its leader (b) and both sets: the first tokens of the symmetric difference.

    ``far`` classes are no links of their leader.  A pair with a far class shares
    so much of either difference that one of the shared tokens lies in the far
    one's first ``n / 4`` or so and in the other one's ``early`` part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, told = [], []
            for i in range(len(batch)):
                x, p = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint64) for k in (2, 3))
                apart = np.setxor1d(x, p, assume_unique=True)
                d, n, slack = len(apart), len(x), 100 - percent
                # The most by which a partner's set can differ from this one.
                most = (n + n * 100 // percent) * slack // (100 + percent)
                some = _first(apart, 0, percent, common.value, min(d, most + 1)) if d else apart
                least = -(-(d * (100 + percent) + (len(p) - n) * slack) // (2 * (100 + percent)))
                rows.append(some)
                told.append((i, len(some), n, d, d * (100 + percent) > (n + len(p)) * slack, d - max(least, 1)))
            if not told:
                continue
            i, m, n, d, far, early = (np.array(v) for v in zip(*told))
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in m])
            own = pa.array(np.repeat(i, m))
            columns = [np.concatenate(rows).view(np.int64), np.repeat(n, m).astype(np.int32), np.repeat(d, m).astype(np.int32), at, np.repeat(far, m), at <= np.repeat(early, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, columns)], names=["rep", "leader", "token", "n", "d", "at", "far", "early"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    # 1. Signatures, classes and the sketch of common tokens.
    signed = scratch.put(texts.mapInArrow(_signatures(id_col, size), f"`{id_col}` {kind}, n long, one long, two long, cells array<struct<cell:int,n:long>>"), "signed", 2000)
    cells = signed.where("cells IS NOT NULL").select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).where("n >= 8")
    common = np.zeros(_CELLS, dtype=np.uint8)
    cells = cells.toPandas()  # no more rows than the sketch has cells
    common[cells["cell"].to_numpy(dtype=np.int64)] = np.ceil(np.log2(cells["n"].to_numpy(dtype=np.float64) + 1))
    shared = spark.sparkContext.broadcast(common)
    signed = signed.where("n >= 0").drop("cells")
    classes = scratch.put(signed.where("n > 0").groupBy("one", "two", "n").agg(F.min(id_col).alias("rep")), "classes")
    # 2. Prefix tokens that several classes share.
    entries = texts.select("text").mapInArrow(_prefixes(shared, size, percent), "token long, class long, n int, at int")
    by_token = W.partitionBy("token").orderBy("class")
    entries = entries.repartition(F.col("token")).dropDuplicates(["token", "class"])
    entries = entries.withColumn("before", F.lag("class").over(by_token)).withColumn("after", F.lead("class").over(by_token)).where("before IS NOT NULL OR after IS NOT NULL")
    entries = entries.withColumn("share", F.count("*").over(W.partitionBy("token")))
    entries = entries.select("token", F.col("class").alias("one"), "n", "at", "share").join(classes.select("one", "rep", F.col("n").cast("int").alias("n")), ["one", "n"])
    entries = scratch.put(entries.select("token", "rep", "n", "at", "share"), "entries", 2000)
    scratch.release()

    # Beyond the last token that two prefixes share lie what is left of either set; before it, only what they share.
    possible = f"(times + least(n_a - 1 - last.at_a, n_b - 1 - last.at_b)) * {100 + percent} >= (n_a + n_b) * {percent} AND n_a * 100 >= n_b * {percent} AND n_b * 100 >= n_a * {percent}"
    met_at = [F.count("*").alias("times"), F.max(F.struct("at_a", "at_b")).alias("last"), F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b")]

    def sets_of(pairs: DataFrame, name: str, *columns: str) -> DataFrame:
        some = scratch.put(pairs.select(F.col("a").alias(id_col)).union(pairs.select("b")).distinct(), f"{name}-ids")
        return scratch.put(rows_of(texts, some, id_col).mapInArrow(_whole_sets(id_col, size, percent), f"`{id_col}` {kind}, tokens binary, one array<int>, two array<int>").select(id_col, "tokens", *columns), f"{name}-sets", 2000)

    def with_tokens(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The set of ``a`` travels; the joins on hot ``b`` can be split."""
        left = sets.select(F.col(id_col).alias("a"), F.col("tokens").alias("x"))
        right = sets.select(F.col(id_col).alias("b"), F.col("tokens").alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.put(pairs.select("a", "b"), f"{name}-pairs")
        sets = sets_of(pairs, name, "one", "two")
        firsts = lambda end: sets.select(F.col(id_col).alias(end), F.col("one").alias(f"one_{end}"), F.col("two").alias(f"two_{end}"))
        # The filters of the three orders are intersected here: two rows of a set hold no more than its prefixes.
        met = pairs.join(firsts("a"), "a").join(firsts("b"), "b").where(F.arrays_overlap("one_a", "one_b") & F.arrays_overlap("two_a", "two_b"))
        met = scratch.put(met.select("a", "b"), f"{name}-met")
        out = scratch.put(with_tokens(met, sets).mapInArrow(_verifier(percent), f"a {kind}, b {kind}"), name, 64)
        scratch.drop(f"{name}-pairs", f"{name}-ids", f"{name}-sets", f"{name}-met")
        return out

    # 3. One pivot per class. Of a token's classes it is the one whose tokens are the most widely shared: of near
    # copies that is the text they derive from, which lies nearer to each than they do to each other.
    mine = entries.select("token", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    middle = entries.groupBy("rep").agg((F.sum("share") / F.max("n")).alias("middle"))
    pivots = entries.join(middle, "rep").groupBy("token").agg(F.max(F.struct("middle", "rep", "n", "at")).alias("p")).select("token", F.col("p.rep").alias("b"), F.col("p.n").alias("n_b"), F.col("p.at").alias("at_b"))
    near = scratch.put(mine.join(pivots, "token").where("a <> b").groupBy("a", "b").agg(*met_at).select("a", "b", "times", F.expr(possible).alias("fits")), "near")
    stars = near.where("fits").groupBy("a").agg(F.max(F.struct("times", "b")).alias("s")).select("a", "s.b")
    links = verified(stars, "stars")
    first = connected_components(links, scratch, "first")
    scratch.release()
    # 4. Pairs of one leader in different components.
    followed = scratch.put(near.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > LARGE), "followed")
    led = near.join(followed, "b").groupBy("a").agg(F.max(F.struct("n", "b")).alias("s")).select("a", "s.b").join(followed.select(F.col("b").alias("a")), "a", "left_anti")
    led = scratch.put(led.join(first, led.a == first.id, "left").select("a", "b", F.coalesce("component", "a").alias("place")), "led")
    places = led.select("b", "place").union(followed.join(first, followed.b == first.id, "left").select("b", F.coalesce("component", "b")))
    open_ = scratch.put(places.groupBy("b").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least <> most").select("b"), "open")
    kin = scratch.put(led.join(open_, "b", "left_semi").select("a", "b"), "kin-of")
    scratch.drop("near")
    deltas = with_tokens(kin, sets_of(kin, "kin-of")).mapInArrow(_differences(shared, percent), f"rep {kind}, leader {kind}, token long, n int, d int, at int, far boolean, early boolean")
    deltas = scratch.put(deltas, "deltas", 64)
    own = scratch.put(deltas.where("NOT far").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct(), "own")
    deltas = deltas.join(led.select(F.col("a").alias("rep"), "place"), "rep")
    build = deltas.where("far").select("leader", "token", F.col("rep").alias("a"), F.col("place").alias("place_a"), F.col("n").alias("n_a"), F.col("d").alias("d_a"), F.col("at").alias("at_a"))
    probe = deltas.where("early").select("leader", "token", F.col("rep").alias("b"), F.col("place").alias("place_b"), F.col("n").alias("n_b"), F.col("d").alias("d_b"), F.col("at").alias("at_b"))
    least = f"CEIL((d_a + d_b - FLOOR((n_a + n_b) * {100 - percent} / {100 + percent})) / 2)"
    near = build.join(probe, ["leader", "token"]).where(f"place_a <> place_b AND n_a * 100 >= n_b * {percent} AND n_b * 100 >= n_a * {percent} AND at_a <= d_a - {least} AND at_b <= d_b - {least}")
    kin_links = verified(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "kin")
    scratch.drop("deltas", "kin-of", "kin-of-ids", "kin-of-sets", "open")
    scratch.release()
    # 5. Pairs across components and leaders.
    placed = entries.join(first, entries.rep == first.id, "left").join(led.select(F.col("a").alias("rep"), F.col("b").alias("leader")), "rep", "left")
    placed = placed.select("token", "rep", "n", "at", F.coalesce("component", "rep").alias("place"), F.coalesce("leader", "rep").alias("leader"))
    met = placed.groupBy("token").agg(F.min("place").alias("least"), F.max("place").alias("most"), F.min("leader").alias("one"), F.max("leader").alias("other")).where("least <> most AND one <> other").select("token")
    placed = scratch.put(placed.join(met, "token", "left_semi"), "placed")
    scratch.drop("entries")
    # Members of a component with equal leader, size and place are one row until a pair of such rows can hold a link at all.
    alike = ["token", "place", "leader", "n", "at"]
    places = placed.groupBy(*alike).agg(F.count("*").alias("members")).select("token", "place", "leader", F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    other = places.select("token", F.col("place").alias("place_b"), F.col("leader").alias("leader_b"), F.col("n_a").alias("n_b"), F.col("at_a").alias("at_b"))
    one_token = f"(least(at_a, at_b) + 1 + least(n_a - 1 - at_a, n_b - 1 - at_b)) * {100 + percent} >= (n_a + n_b) * {percent}"
    meets = places.join(other, "token").where(f"place < place_b AND leader <> leader_b AND n_a * 100 >= n_b * {percent} AND n_b * 100 >= n_a * {percent} AND {one_token}")
    mine = placed.select("token", "place", "leader", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    theirs = placed.select("token", F.col("place").alias("place_b"), F.col("leader").alias("leader_b"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    cross = meets.join(mine, ["token", "place", "leader", "n_a", "at_a"]).join(theirs, ["token", "place_b", "leader_b", "n_b", "at_b"])
    more = verified(cross.groupBy("a", "b").agg(*met_at).where(possible), "cross")
    scratch.drop("placed", "led", "followed")
    scratch.release()
    found = connected_components(links.union(own).union(kin_links).union(more), scratch, "second")
    roots = classes.join(found, classes.rep == found.id, "left").select("one", "two", F.col("n").alias("size"), F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(roots, (signed.one == roots.one) & (signed.two == roots.two) & (signed.n == roots["size"]), "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component_id", id_col).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(docs: list[tuple[int, str]], size: int = SHINGLE, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """The contract read literally, for tests; candidates share any shingle."""
    import re
    from collections import defaultdict

    sets, holders = {}, defaultdict(list)
    for doc, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
        for s in sets[doc]:
            holders[s].append(doc)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d] = root[root[d]]
        return d

    for doc, mine in sets.items():
        for other in {o for s in mine for o in holders[s] if o > doc}:
            both = len(mine & sets[other])
            if 100 * both >= percent * (len(mine) + len(sets[other]) - both):
                a, b = find(doc), find(other)
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d)) for d, s in sets.items()]
