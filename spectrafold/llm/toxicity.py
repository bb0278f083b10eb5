"""Toxicity by weak supervision.

1. Lexicons are mined from the labelled rows that are not held out: words and
   word beginnings whose document frequency among toxic rows far exceeds that
   among clean ones, over all such rows.
2. Thirteen voters look at every document: a fixed list of insults, four word
   lexicons by how widely their words spread among toxic rows, four lexicons of
   word beginnings likewise, one for several weak signs, and three patterns:
   disguised words (letters starred or spaced out), heated writing (a letter
   four times or more, three exclamation marks), and an insult of the fixed list
   within four words after "you".
3. A generative label model explains how often each pattern of votes occurs in
   the whole corpus: latent class, hit rates of each voter per class.  Voters
   that are correlated within a class are modelled jointly, as one block.
4. A linear classifier over the mined features and the patterns is trained on the posterior
   labels of at most ``TRAIN_ROWS`` documents that are not held out (those of
   least hash) and scores every document.

The corpus is read by maps only; what is shuffled are feature counts of toxic
rows, combined per task first.  Of the features that tell toxic rows apart at most
``MAX_FEATURES`` are kept, those of most evidence, so the broadcast model has a
fixed bound.

Defined results: null and empty texts have no features and get the model's
base score; labels that are null are ignored and of several labels of an id
the highest counts; repeated rows each get a row; without labels the fixed
list and the patterns alone vote; ties of equal features fall by their hash; a
very long text is one run, read whole, at some dozens of bytes of memory a byte;
other columns of the documents are passed or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._store import Scratch, bounded_batches
from spectrafold.llm._text import ALNUM, Words, _Powers, mix, split_words, text_chunks

#: Fixed list of English insults; the first voter.
INSULTS = "clown creep disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless".split()
THRESHOLD = 0.3
MIN_TOXIC = 6
MAX_FEATURES = 50_000
TRAIN_ROWS = 40_000
#: Ids of labelled rows that may be broadcast (8 bytes each); beyond it the labels are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_LEXICONS = 4
_BEGINNINGS = (4, 5, 6, 7, 8)
#: The lexicons hold features by the share of toxic rows they occur in.
_TIERS = (0.004, 0.012, 0.036)
PATTERNS = ("disguised", "heated", "addressed")
VOTERS = 2 + 2 * _LEXICONS + len(PATTERNS)
#: Words that an insult is addressed by, and how many words after them it may stand.
ADDRESS, REACH = "you your youre u ur yourself".split(), 4


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word and of its beginnings, with the text of each; the lowest bit tells the two apart."""
    one = np.uint64(1)
    out, doc = [words.hash & ~one], [words.doc]
    up, down = _Powers.upto(len(words.low) + 1)
    sums = np.zeros(len(words.low) + 1, dtype=np.uint64)
    np.cumsum((words.low.astype(np.uint64) + one) * up[: len(words.low)], out=sums[1:])
    length = words.end - words.start
    for k in _BEGINNINGS:
        some = length >= k
        a = words.start[some]
        out.append(mix((sums[a + k] - sums[a]) * down[a] + np.uint64(k)) | one)
        doc.append(words.doc[some])
    return np.concatenate(out), np.concatenate(doc)


#: Features that stand for the patterns.
_PATTERN_KEYS = mix(np.arange(1, len(PATTERNS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(1)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_STAR = np.zeros(256, dtype=bool)
_STAR[list(b"*#$@!")] = True


def _word_hashes(words: Sequence[str]) -> np.ndarray:
    _, _, data, offsets = next(text_chunks(pa.array([" ".join(words)])))
    return split_words(data, offsets, ALNUM).hash & ~np.uint64(1)


def pattern_hits(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Whether each pattern occurs in each text, one row a pattern.

    Disguised: ``[A-Za-z][*#$@!]+[A-Za-z]`` with at least one ``*``, ``#`` or ``$``,
    or four letters, each alone, with one blank between.  Heated: one letter four
    times or more, or ``!!!``.  Addressed: a word of ``ADDRESS`` and one of
    ``INSULTS`` at most ``REACH`` words later.
    """
    texts = len(offsets) - 1
    out = np.zeros((len(PATTERNS), texts), dtype=bool)

    def mark(pattern: int, first: np.ndarray, last: np.ndarray) -> None:
        doc = np.searchsorted(offsets, first, side="right") - 1
        out[pattern, doc[last < offsets[doc + 1]]] = True

    n = len(data)
    letter = _LETTER[data]
    # Runs of stars, cut at the ends of texts.
    star = np.flatnonzero(_STAR[data])
    if len(star):
        text = np.searchsorted(offsets, star, side="right") - 1
        head = np.flatnonzero(np.r_[True, (star[1:] != star[:-1] + 1) | (text[1:] != text[:-1])])
        first, last = star[head], star[np.r_[head[1:], len(star)] - 1]
        true = np.logical_or.reduceat((data[star] != 0x40) & (data[star] != 0x21), head)
        inner = true & (first > 0) & (last < n - 1)
        first, last = first[inner] - 1, last[inner] + 1
        both = letter[first] & letter[last]
        mark(0, first[both], last[both])
    if n >= 7:
        # A letter alone: no letter or digit beside it in its own text.
        beside = ALNUM[data]
        left, right = np.r_[False, beside[:-1]], np.r_[beside[1:], False]
        left[offsets[:-1][offsets[:-1] < n]] = False
        right[offsets[1:][offsets[1:] > 0] - 1] = False
        alone = letter & ~left & ~right
        at = np.flatnonzero(alone)
        at = at[at + 6 < n]
        for k in (1, 2, 3):
            at = at[alone[at + 2 * k] & (data[at + 2 * k - 1] == 0x20)]
        mark(0, at, at + 6)
    if n >= 4:
        low = words.low
        same = low[1:] == low[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & letter[:-3])
        mark(1, at, at + 3)
    if n >= 3:
        cry = data == 0x21
        at = np.flatnonzero(cry[:-2] & cry[1:-1] & cry[2:])
        mark(1, at, at + 2)
    plain = words.hash & ~np.uint64(1)
    you, insult = np.flatnonzero(np.isin(plain, _ADDRESS_HASHES)), np.isin(plain, _INSULT_HASHES)
    for k in range(1, REACH + 1):
        some = you[you + k < len(plain)]
        some = some[insult[some + k] & (words.doc[some] == words.doc[some + k])]
        out[2, words.doc[some]] = True
    return out


_INSULT_HASHES, _ADDRESS_HASHES = _word_hashes(INSULTS), _word_hashes(ADDRESS)


def _per_text(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, distinct features, text of each) by run of texts."""
    for begin, end, data, offsets in text_chunks(column):
        words = split_words(data, offsets, ALNUM)
        hashes, doc = _features(words)
        pattern, where = np.nonzero(pattern_hits(data, offsets, words))
        hashes, doc = np.r_[hashes, _PATTERN_KEYS[pattern]], np.r_[doc, where]
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, dtype=bool)
        yield end - begin, hashes[new], doc[new]


def _counted(batches: Iterator[pa.RecordBatch], chosen: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Document frequencies of features within a task, in pieces of bounded size."""
    held, total = [], 0

    def flush():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["feature", "n"])

    for batch in batches:
        for _, hashes, _ in _per_text(batch.column(0)):
            if chosen is not None and not len(chosen):
                continue
            if chosen is not None:
                at = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
                hashes = hashes[chosen[at] == hashes]
            held.append(hashes)
            total += len(hashes)
            if total > 2 << 20:
                yield flush()
                held, total = [], 0
    if total:
        yield flush()


@dataclass
class Model:
    """Sorted feature hashes with weight, voter and strength; the posterior of each vote pattern."""

    features: np.ndarray
    voter: np.ndarray
    weak: np.ndarray
    weights: np.ndarray
    bias: float
    posterior: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = self.features[at] == hashes
        return at[hit], hit

    def votes(self, n: int, found: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        np.bitwise_or.at(out, doc, self.voter[found])
        several = np.bincount(doc, self.weak[found], minlength=n) >= 2
        return out | (several.astype(np.int64) << (VOTERS - 1))

    def scores(self, n: int, found: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + np.bincount(doc, self.weights[found], minlength=n))))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """Texts of toxic and of clean rows that labels may be learnt from, those labels and their numbers."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy((F.col("label") > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    out = []
    for toxic in (True, False):
        ids = known.where((F.col("label") > 0) == toxic).select(id_col)
        small = counts.get(toxic, 0) <= BROADCAST_IDS
        out.append(texts.join(F.broadcast(ids) if small else ids, id_col, "left_semi").select("text"))
    return out[0], out[1], known, counts.get(True, 0), counts.get(False, 0)


def _label_model(patterns: dict[int, int], anchors: dict[int, tuple[int, int]], start: np.ndarray, prior: float) -> np.ndarray:
    """P(toxic | votes) for each vote pattern, by EM over the corpus's pattern counts.

    ``anchors`` holds the counts of each pattern among rows known to be clean
    and toxic; they keep the classes in place, with as much weight in all as the
    unlabelled rows.  ``start[j, c]`` is voter j's first guess of its hit rate
    in class c.  After a fit with independent voters, pairs whose votes are
    correlated within a class are joined into blocks of at most three voters and
    the model is fitted again with one table per block and class.
    """
    keys = np.array(sorted(patterns), dtype=np.int64)
    n = np.array([patterns[k] for k in keys], dtype=float)
    known = np.array([anchors.get(k, (0, 0)) for k in keys], dtype=float)
    known *= n.sum() / max(1.0, known.sum())
    bits = (keys[:, None] >> np.arange(VOTERS)) & 1
    post = np.full(len(keys), prior)

    def joint(blocks, tables, share):
        log = np.log(np.array([1 - share, share]))[None, :].repeat(len(keys), 0)
        for block, table in zip(blocks, tables):
            log = log + np.log(table[(bits[:, block] << np.arange(len(block))).sum(1)])
        log -= log.max(1, keepdims=True)
        e = np.exp(log)
        return e[:, 1] / e.sum(1)

    def fit(blocks, post, share):
        for _ in range(100):
            tables = []
            for block in blocks:
                cell = (bits[:, block] << np.arange(len(block))).sum(1)
                table = np.stack([np.bincount(cell, n * (1 - post) + known[:, 0], 1 << len(block)), np.bincount(cell, n * post + known[:, 1], 1 << len(block))], 1) + 0.01
                tables.append(table / table.sum(0))
            share = np.clip(((n * post).sum() + known[:, 1].sum()) / (n.sum() + known.sum()), 1e-4, 0.5)
            new = joint(blocks, tables, share)
            if np.abs(new - post).max() < 1e-7:
                return new, share
            post = new
        return post, share

    single = [[j] for j in range(VOTERS)]
    post = joint(single, [np.stack([1 - start[j], start[j]]) for j in range(VOTERS)], prior)
    post, share = fit(single, post, prior)
    # Correlation within classes, weighted by the posterior.
    linked = []
    for i in range(VOTERS):
        for j in range(i + 1, VOTERS):
            for weight in (n * post, n * (1 - post)):
                total = weight.sum() + 1e-9
                a, b = (weight * bits[:, i]).sum() / total, (weight * bits[:, j]).sum() / total
                spread = np.sqrt(a * (1 - a) * b * (1 - b))
                if total > 50 and spread > 1e-6:
                    linked.append((abs((weight * bits[:, i] * bits[:, j]).sum() / total - a * b) / spread, i, j))
    blocks = {j: [j] for j in range(VOTERS)}
    for strength, i, j in sorted(linked, reverse=True):
        if strength >= 0.15 and blocks[i] is not blocks[j] and len(blocks[i]) + len(blocks[j]) <= 3:
            whole = blocks[i] + blocks[j]
            for k in whole:
                blocks[k] = whole
    post, _ = fit([list(b) for b in {tuple(b) for b in blocks.values()}], post, share)
    out = np.full(1 << VOTERS, np.nan)
    out[keys] = post
    return out


def _classifier(rows: list[np.ndarray], target: np.ndarray, size: int, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities, by accelerated full gradient steps."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(row) else np.zeros(0, dtype=np.int64)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    share = np.clip(target.mean() if len(target) else 0.01, 1e-3, 0.5)
    w[-1] = np.log(share / (1 - share))
    for step in range(1, 601):
        p = 1 / (1 + np.exp(-(w[-1] + np.bincount(row, w[col], minlength=len(rows)))))
        slack = (p - target) / max(1, len(rows))
        g = np.r_[np.bincount(col, slack[row], minlength=size), slack.sum()] + penalty * np.r_[w[:-1], 0] / max(1, len(rows)) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    toxic, clean, known, n_toxic, n_clean = _labelled(docs, labels, id_col, text_col, label_col)
    scratch = Scratch(spark, "toxicity")
    counted = lambda texts, chosen=None: texts.mapInArrow(lambda b: _counted(b, chosen and chosen.value), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    often = scratch.put(counted(toxic).where(F.col("n") >= MIN_TOXIC), "often")
    # Few features are looked up among the clean texts as they are read; more meet in a join.
    few = often.count() <= BROADCAST_IDS
    chosen = spark.sparkContext.broadcast(np.sort(often.select("feature").toPandas()["feature"].to_numpy(dtype=np.int64).view(np.uint64))) if few else None
    met = often.join(counted(clean, chosen).withColumnRenamed("n", "c"), "feature", "left").na.fill(0, ["c"])
    odds = F.log((F.col("n") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    # What tells toxic rows apart stays, by weight of evidence where that is too much.
    kept = met.withColumn("odds", odds).where(F.col("odds") >= 1.5).orderBy(F.desc(F.col("odds") * F.log1p("n")), "feature").limit(MAX_FEATURES).toPandas()
    keys, t, odds = kept["feature"].to_numpy(dtype=np.int64).view(np.uint64), kept["n"].to_numpy(dtype=float), kept["odds"].to_numpy(dtype=float)
    fixed = np.setdiff1d(np.r_[_INSULT_HASHES, _PATTERN_KEYS], keys)
    keys, odds = np.concatenate([keys, fixed]), np.concatenate([odds, np.full(len(fixed), 3.5)])
    order = np.argsort(keys)
    keys, odds = keys[order], odds[order]
    share = np.concatenate([t, np.zeros(len(fixed))])[order] / max(1, n_toxic)
    group = np.searchsorted(_TIERS, share, side="right")
    strong = odds >= 3
    voter = np.where(strong, 1 << (1 + group + _LEXICONS * (keys & np.uint64(1)).astype(np.int64)), 0)
    voter |= np.isin(keys, _INSULT_HASHES).astype(np.int64)
    for k, key in enumerate(_PATTERN_KEYS):
        voter[keys == key] = 1 << (1 + 2 * _LEXICONS + k)
    model = Model(keys, voter, ((odds < 3) & ~np.isin(keys, _PATTERN_KEYS)).astype(float), np.zeros(len(keys)), 0.0, np.zeros(1 << VOTERS))
    voted = scratch.put(_looked(docs, model, id_col, text_col), "voted")
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    met = voted.join(known, id_col).groupBy("votes").agg(F.count_if(F.col("label") <= 0).alias("clean"), F.count_if(F.col("label") > 0).alias("toxic"))
    anchors = {r["votes"]: (r["clean"], r["toxic"]) for r in met.collect()}
    start = np.full((VOTERS, 2), [0.003, 0.3])
    model.posterior = _label_model(patterns, anchors, start, n_toxic / (n_toxic + n_clean) if n_toxic else 0.05) if patterns else model.posterior
    sample = voted.where(~held_out(id_col)).orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS).select("votes", "found").toPandas()
    target = model.posterior[sample["votes"].to_numpy(dtype=np.int64)]
    model.weights, model.bias = _classifier(list(sample["found"]), target, len(keys))
    scratch.drop("voted", "often")
    return model


def _looked(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """Votes and features found of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            votes, lists = [], []
            for n, hashes, doc in _per_text(batch.column(1)):
                found, hit = m.find(hashes)
                doc = doc[hit]
                votes.append(m.votes(n, found, doc))
                lists += [x for x in np.split(found.astype(np.int32), np.searchsorted(doc, np.arange(1, n)))]
            votes = np.concatenate(votes) if votes else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes), pa.array(lists, pa.list_(pa.int32()))], names=[id_col, "votes", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, votes long, found array<int>")


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score, in one map."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for n, hashes, doc in _per_text(batch.column(at).cast(pa.string())):
                found, hit = m.find(hashes)
                out.append(m.scores(n, found, doc[hit]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
