"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer
words is one window).  A block is a pair of adjacent words.  The shift table
maps a block's hash to how far the scan may jump without missing a window; a
shift of zero leads to the suffix bucket, whose windows are compared word for
word.  Many text segments are scanned in step, so each jump is one vectorised
table lookup over all segments.

The scan is a map over the documents without a shuffle.  The benchmark is cut
into blocks of bounded bytes; each block is broadcast and scanned in its own
pass, and with more than one block the passes meet in one aggregation by row.

Defined results: null or empty texts have no words, no hits and are clean;
repeated rows each get a row; an empty benchmark hits nothing; items that are
null or have no words are ignored, as are items without id; other columns are
not read.  Equal windows in many items report every item.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._text import ALNUM, Words, mix, split_words, text_chunks

WINDOW = 13
#: Benchmark text per pass; what a pass broadcasts is a small multiple of it.
BLOCK_BYTES = 8 << 20
_LANE = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _normal(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single blanks, with each word's place."""
    length = words.end - words.start
    at = np.zeros(len(length) + 1, dtype=np.int64)
    np.cumsum(length + 1, out=at[1:])
    out = np.full(at[-1], 0x20, dtype=np.uint8)
    shift = np.repeat(at[:-1] - words.start, length)
    source = np.arange(len(shift)) - np.repeat(np.cumsum(length) - length - words.start, length)
    out[source + shift] = words.low[source]
    return out.tobytes(), at[:-1], at[:-1] + length


class _Length:
    """Shift table and suffix buckets for all windows of one length."""

    def __init__(self, size: int, windows: dict[bytes, tuple[int, np.ndarray]]):
        self.size, self.block = size, min(2, size)
        texts = list(windows)
        hashes = np.array([windows[t][1] for t in texts], dtype=np.uint64).reshape(len(texts), size)
        bits = max(12, min(22, int(np.ceil(np.log2(8 * hashes.size + 1)))))
        self.mask = np.uint64((1 << bits) - 1)
        far = size - self.block + 1
        self.shift = np.full(1 << bits, far, dtype=np.int64)
        for end in range(self.block - 1, size):
            np.minimum.at(self.shift, self.key(hashes[:, end], hashes[:, end - self.block + 1]) & self.mask, size - 1 - end)
        self.buckets: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        for text, key in zip(texts, self.key(hashes[:, -1], hashes[:, -self.block]).tolist()):
            self.buckets[key].append((text, windows[text][0]))
        self.keys = np.array(sorted(self.buckets), dtype=np.uint64)

    @staticmethod
    def key(last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return mix(last * _STEP + before)

    def ends(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word positions where a window may end, with their block keys."""
        size, first = self.size, words.first
        low, high = first[:-1] + size - 1, first[1:]
        fits = high > low
        low, high = low[fits], high[fits]
        lanes = -(-(high - low) // _LANE)
        base = np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(low, lanes) + (np.arange(int(lanes.sum())) - base) * _LANE
        stop = np.minimum(at + _LANE, np.repeat(high, lanes))
        found, keys = [], []
        while len(at):
            key = self.key(words.hash[at], words.hash[at - self.block + 1])
            jump = self.shift[key & self.mask]
            hit = jump == 0
            if hit.any():
                found.append(at[hit])
                keys.append(key[hit])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at, key = np.concatenate(found), np.concatenate(keys)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            real = self.keys[place] == key
            at, key = at[real], key[real]
        return at, key


class Patterns:
    """The windows of a bounded block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.string())
        owners: dict[bytes, set[str]] = defaultdict(set)
        by_size: dict[int, dict[bytes, tuple[int, np.ndarray]]] = defaultdict(dict)
        ids: dict[bytes, int] = {}
        for begin, end, data, offsets in text_chunks(texts):
            words = split_words(data, offsets, ALNUM)
            normal, start, stop = _normal(words)
            for d in range(end - begin):
                a, b = int(words.first[d]), int(words.first[d + 1])
                size = min(window, b - a)
                for i in range(a, b - size + 1 if size else a):
                    text = normal[start[i] : stop[i + size - 1]]
                    owners[text].add(items[begin + d][0])
                    if text not in ids:
                        ids[text] = len(ids)
                        by_size[size][text] = (ids[text], words.hash[i : i + size].copy())
        self.owners = [sorted(owners[t]) for t in ids]
        self.lengths = [_Length(size, windows) for size, windows in sorted(by_size.items())]

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """(marks of the words that are hit, items by text)."""
        hit = np.zeros(len(words.hash) + 1, dtype=np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        normal = None
        for table in self.lengths:
            at, keys = table.ends(words)
            if not len(at):
                continue
            if normal is None:
                normal, start, stop = _normal(words)
            begin = at - table.size + 1
            for i, a, b, key in zip(begin.tolist(), start[begin].tolist(), stop[at].tolist(), keys.tolist()):
                said = normal[a:b]
                for text, window in table.buckets[key]:
                    if text == said:
                        hit[i] += 1
                        hit[i + table.size] -= 1
                        items[int(words.doc[i])].update(self.owners[window])
        return np.cumsum(hit)[:-1] > 0, items


def _runs(marks: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return [{"a": a, "b": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


_HITS = "n_words long, n_hit long, hits array<struct<a:long,b:long>>, items array<string>"


def _scanner(patterns):
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = patterns.value
        for batch in batches:
            n_words, n_hit, hits, items = [], [], [], []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                words = split_words(data, offsets, ALNUM)
                marks, found = compiled.scan(words)
                total = np.r_[0, np.cumsum(marks)]
                n_words += np.diff(words.first).tolist()
                n_hit += (total[words.first[1:]] - total[words.first[:-1]]).tolist()
                for d in range(len(offsets) - 1):
                    a, b = words.first[d], words.first[d + 1]
                    hits.append(_runs(marks[a:b]) if d in found else [])
                    items.append(sorted(found.get(d, ())))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "n_hit", "hits", "items"])

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_hit, hits (word ranges ``[a, b)``) and items (ids as sorted strings)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    source = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).dropna()
    size = source.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()

    def one(block: int) -> DataFrame:
        part = source if blocks == 1 else source.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        patterns = spark.sparkContext.broadcast(Patterns([tuple(r) for r in part.collect()], window))
        return texts.mapInArrow(_scanner(patterns), f"row {kind}, {_HITS}")

    if blocks == 1:
        found = one(0)
    else:
        # Each row gets a key of its own, as ids may repeat; a pass over a block of patterns scans the same rows.
        texts = texts.select(F.struct("row", F.monotonically_increasing_id().alias("at")).alias("row"), "text")
        kind = texts.schema["row"].dataType.simpleString()
        passes = one(0)
        for block in range(1, blocks):
            passes = passes.unionByName(one(block))
        met = passes.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        joined = F.aggregate(
            F.array_sort("runs"),
            F.array().cast("array<struct<a:long,b:long>>"),
            lambda out, r: F.when(
                (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["b"] >= r["a"]),
                F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(out, F.lit(-1))["b"], r["b"]).alias("b")))),
            ).otherwise(F.concat(out, F.array(r))),
        )
        found = met.withColumn("hits", joined).withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"]))
        found = found.select(F.col("row.row").alias("row"), "n_words", "n_hit", "hits", "items")
    return found.withColumnRenamed("row", id_col)


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    """At least a twentieth of the words lie in benchmark windows."""
    return (F.col(n_hit) > 0) & (F.lit(20) * F.col(n_hit) >= F.col(n_words))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        "hits",
    )


def brute_force(docs: list[tuple[int, str]], items: list[tuple[int, str]], window: int = WINDOW) -> list[tuple]:
    """The contract read literally, for tests."""
    import re

    def split(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)

    windows = defaultdict(set)
    for item, text in items:
        words = split(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    out = []
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (key := tuple(words[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[key]
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out
