"""Removal of passages that occur more than once, anchored on fixed blocks.

A window is ``WINDOW`` consecutive words of one document.  Every document is cut
into reference blocks of ``BLOCK`` words that do not overlap; as a window is
``2 * BLOCK - 1`` words long, it holds exactly one whole block of its own
document.  So two equal windows each hold a block that the other holds at some
offset, and repeats are found from blocks alone:

1. **Index and probe.**  Texts are packed into compressed chunks.  Each chunk sends the
   hash of every rolling run of ``BLOCK`` words once to the bucket of that
   hash, marked if it is a reference block, 4 bytes a word.  A bucket tells
   each chunk which of its runs are blocks that occur at least twice: anchors.
2. **Extend.**  A window takes the anchor of least hash in it; neighbouring
   windows with one anchor make an extension, the words around that anchor as
   far as its windows reach.  Equal windows take the same anchor, so the
   windows to compare are those of one anchor.  Extensions equal in all words
   are counted before anything is compared: copies of whole documents and the
   inside of shared passages end here.  The windows of the extensions left are
   matched one by one, which gives the exact ends of each maximal repeat.
3. **Remove.**  Verdicts go back to the chunks; a word goes if a repeated
   window covers it.

Nothing pairs occurrences: a passage in a third of all documents costs one row
for each chunk that holds it.  Buckets are ranges of hashes that hold about
``BUCKET_BYTES`` of text each, so their number grows with the input and their
size does not.  Bucket entries keep 30 bits beside the bucket, which can only
add anchors; windows are compared by 64 bits of their words and 64 of their
anchor.  Texts over a chunk are read in pieces that overlap by a window less
one word.

Defined results: words are maximal ``[^\\x20\\x09-\\x0D]+`` and case counts; null
or empty texts have no words; a document of fewer words than a window loses
none; every copy of a repeat is removed, the first one too, and overlapping
occurrences in one document count as two; repeated rows repeat each other and
each get a row; ids may be null and other columns are not read; empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._store import Scratch
from spectrafold.llm._text import SPACED, Words, _Powers, mix, split_words, text_chunks

BLOCK = 18
WINDOW = 2 * BLOCK - 1
CHUNK_BYTES = 1 << 20
#: Text whose rolling runs share a bucket.
BUCKET_BYTES = 8 << 20
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_SEEDS = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)


def _packer(limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1), limit):
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
                columns = [ids, pa.array([pa.compress(data.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([offsets.tobytes()], pa.binary()), pa.array([len(data)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "data", "offsets", "bytes"])

    return pack


def _bytes(column: pa.Array, row: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), dtype=kind)


def _texts(batch: pa.RecordBatch, row: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a chunk's texts, from the columns ``data``, ``offsets`` and ``bytes``."""
    data = pa.decompress(batch.column(first)[row].as_buffer(), batch.column(first + 2)[row].as_py(), "zstd")
    return np.frombuffer(data, dtype=np.uint8), _bytes(batch.column(first + 1), row, np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, Words]]:
    """The words of a chunk with the place of the first: one piece, or pieces of one long text.

    A piece ends with the ``WINDOW - 1`` words that follow it, so each window lies in one piece.
    """
    if len(data) <= 2 * limit or len(offsets) > 2:
        yield 0, split_words(data, offsets, SPACED, fold=False)
        return
    at, base, text = 0, 0, data.tobytes()
    while at < len(text):
        end = at + limit
        while end < len(text) and SPACED[text[end]]:
            end += 1
        ahead: list[bytes] = []
        reach = 4096
        while end < len(text):
            ahead = text[end : end + reach].split(None, WINDOW)
            if len(ahead) > WINDOW or end + reach >= len(text):
                break
            reach *= 2
        piece = np.frombuffer(text[at:end] + b" " + b" ".join(ahead[: WINDOW - 1]), dtype=np.uint8)
        words = split_words(piece, np.array([0, len(piece)], dtype=np.int64), SPACED, fold=False)
        yield base, words
        base += len(words.hash) - len(ahead[: WINDOW - 1])
        at = max(end, at + 1)


class _Rolling:
    """Hashes of runs of words, none across documents."""

    def __init__(self, words: Words):
        self.h, self.n = words.hash, len(words.hash)
        up, self.down = _Powers.upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=_U)
        np.cumsum(self.h * up[: self.n], out=self.sums[1:])
        self.doc, self.first = words.doc, words.first

    def of(self, start: np.ndarray, length: np.ndarray | int, seed: np.uint64) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + seed * np.asarray(length).astype(_U))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, is a reference block) of the runs of ``BLOCK`` words of documents that hold a window."""
        if self.n < WINDOW:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U), np.zeros(0, dtype=bool)
        counts = np.diff(self.first)
        whole = (self.doc[: self.n - BLOCK + 1] == self.doc[BLOCK - 1 :]) & (counts[self.doc[: self.n - BLOCK + 1]] >= WINDOW)
        start = np.flatnonzero(whole)
        return start, self.of(start, BLOCK, _SEEDS[0]), (start - self.first[self.doc[start]]) % BLOCK == 0


def _place(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & _U(0xFFFFFFFF)) % _U(buckets), h >> _U(34)


def _sender(buckets: int, limit: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for _, words in _pieces(*_texts(batch, row, 1), limit):
                    _, h, block = _Rolling(words).runs()
                    if not len(h):
                        continue
                    order = np.argsort(h, kind="stable")
                    h, block = h[order], block[order]
                    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                    many = np.diff(np.r_[edge, len(h)]) > 1
                    bucket, rest = _place(h[edge], buckets)
                    entry = (rest << _U(2)) | (np.logical_or.reduceat(block, edge).astype(_U) << _U(1)) | many.astype(_U)
                    order = np.argsort(bucket, kind="stable")
                    bucket, entry = bucket[order], entry[order].astype(np.uint32)
                    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    packed = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer((np.r_[edge, len(entry)] * 4).astype(np.int32).tobytes()), pa.py_buffer(entry.tobytes())])
                    columns = [pa.array(bucket[edge].astype(np.int64)), pa.array(np.full(len(edge), batch.column(0)[row].as_py(), dtype=np.int64)), packed]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "entries"])

    return send


_HITS = "bucket long, chunk long, hits binary"


def _match(group: pa.Table) -> pa.Table:
    """Anchors of one bucket, for each chunk that sent them."""
    group = group.combine_chunks()
    sent = group["entries"].combine_chunks() if isinstance(group["entries"], pa.ChunkedArray) else group["entries"]
    if isinstance(sent, pa.ChunkedArray):
        sent = pa.concat_arrays(sent.chunks)
    each = [_bytes(sent, i, np.uint32) for i in range(len(sent))]
    entry = np.concatenate(each)
    owner = np.repeat(group["chunk"].to_numpy(), [len(x) for x in each])
    order = np.argsort(entry >> np.uint32(2), kind="stable")
    entry, owner = entry[order], owner[order]
    rest = entry >> np.uint32(2)
    edge = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
    flags = np.bitwise_or.reduceat(entry & np.uint32(3), edge)
    size = np.diff(np.r_[edge, len(rest)])
    anchor = np.repeat((flags >= 2) & ((size > 1) | (flags & 1 == 1)), size)
    rest, owner = rest[anchor], owner[anchor]
    order = np.argsort(owner, kind="stable")
    rest, owner = rest[order], owner[order]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=np.int64)
    hits = [rest[a:b].tobytes() for a, b in zip(edge, np.r_[edge[1:], len(rest)])]
    bucket = group["bucket"][0].as_py()
    return pa.table({"bucket": pa.array([bucket] * len(edge), pa.int64()), "chunk": pa.array(owner[edge], pa.int64()), "hits": pa.array(hits, pa.binary())})


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` neighbouring keys, the first of equal ones."""
    at, have = np.arange(len(keys)), 1

    def join(left, right):
        return np.where(keys[left] <= keys[right], left, right)

    while have * 2 <= width:
        at = join(at[:-have], at[have:])
        have *= 2
    return join(at[: len(keys) - width + 1], at[width - have :][: len(keys) - width + 1])


_EXTENSIONS = "chunk long, anchor long, words long, times int, places array<int>, windows array<long>"


def _extender(buckets: int, limit: int):
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                told = batch.column(4)[row].values
                known = [np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(_U) + (_U(b) << _U(30)) for b, x in zip(told.field("bucket").to_pylist(), told.field("hits"))]
                known = np.sort(np.concatenate(known))
                for base, words in _pieces(*_texts(batch, row, 1), limit):
                    found = _extensions(words, known, buckets, base)
                    if found is not None:
                        chunk = pa.array(np.full(found.num_rows, batch.column(0)[row].as_py(), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([chunk, *found.columns], names=["chunk", *found.schema.names])

    return extend


def _extensions(words: Words, known: np.ndarray, buckets: int, base: int) -> pa.RecordBatch | None:
    rolling = _Rolling(words)
    start, h, _ = rolling.runs()
    if not len(h):
        return None
    bucket, rest = _place(h, buckets)
    key = rest + (bucket << _U(30))
    hit = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
    if not hit.any():
        return None
    keys = np.full(rolling.n - BLOCK + 1, _NONE, dtype=_U)
    keys[start[hit]] = np.minimum(h[hit], _NONE - _U(1))
    windows = rolling.n - WINDOW + 1
    at = _least(keys, WINDOW - BLOCK + 1)[:windows]
    good = (keys[at] != _NONE) & (rolling.doc[:windows] == rolling.doc[WINDOW - 1 :])
    place = np.flatnonzero(good)
    if not len(place):
        return None
    at = at[place]
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)])
    n = np.diff(np.r_[edge, len(place)])
    first = place[edge]
    anchor, said = keys[at[edge]], rolling.of(first, n + WINDOW - 1, _SEEDS[1])
    # Equal extensions of the piece become one row with all their places.
    order = np.lexsort((said, anchor))
    new = np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (said[order][1:] != said[order][:-1])]
    group = np.flatnonzero(new)
    one = order[group]
    places = pa.ListArray.from_arrays(pa.array(np.r_[group, len(order)].astype(np.int32)), pa.array((first[order] + base).astype(np.int32)))
    span = n[one]
    ends = np.cumsum(span)
    source = np.arange(int(ends[-1])) - np.repeat(ends - span, span) + np.repeat(first[one], span)
    own = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(rolling.of(source, WINDOW, _SEEDS[1]).view(np.int64)))
    columns = [pa.array(anchor[one].view(np.int64)), pa.array(said[one].view(np.int64)), pa.array(np.diff(np.r_[group, len(order)]).astype(np.int32)), places, own]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "words", "times", "places", "windows"])


def _covered(told: pa.Array) -> np.ndarray:
    """Marks of the covered words of a chunk, as far as the last one."""
    places = told.field("places")
    lengths = np.diff(places.offsets.to_numpy())
    lo = places.values.to_numpy(zero_copy_only=False)[places.offsets[0].as_py() :][: int(lengths.sum())].astype(np.int64)
    mask = np.repeat(told.field("mask").to_numpy(zero_copy_only=False), lengths)
    edge = np.zeros(int(lo.max()) + BLOCK + WINDOW + 1, dtype=np.int64)
    for k in range(WINDOW - BLOCK + 1):
        starts = lo[(mask >> k) & 1 == 1] + k
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge) > 0


def _remover(limit: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, offsets = _texts(batch, row, 2)
                told = batch.column(5)[row].values
                marks = _covered(told) if told is not None and len(told) else np.zeros(0, dtype=bool)
                at, n_words, n_removed, sums, runs, texts = 0, [], [], [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    begun, gone, kept, digest = at, 0, [], hashlib.sha256()
                    blank = b""
                    while a < b:
                        end = min(a + limit, b)
                        while end < b and SPACED[data[end]]:
                            end += 1
                        words = data[a:end].tobytes().split()
                        cut = marks[at : at + len(words)]
                        at, a = at + len(words), end
                        if cut.any():
                            gone += int(cut.sum())
                            words = [w for w, c in zip(words, np.r_[cut, np.zeros(len(words) - len(cut), dtype=bool)].tolist()) if not c]
                        if words:
                            said = blank + b" ".join(words)
                            blank = b" "
                            digest.update(said)
                            if with_text:
                                kept.append(said)
                    n_words.append(at - begun)
                    n_removed.append(gone)
                    sums.append(digest.hexdigest())
                    edge = np.flatnonzero(np.diff(np.r_[0, marks[begun:at].astype(np.int8), 0])).tolist() if gone else []
                    runs.append([{"a": x, "b": y} for x, y in zip(edge[::2], edge[1::2])])
                    texts.append(b"".join(kept).decode() if with_text else None)
                kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                columns = [batch.column(1)[row].values, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string()), pa.array(runs, kind)]
                names = ["id", "n_words", "n_removed", "kept_sha256", "removed"]
                if with_text:
                    columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_removed, kept_sha256, removed (word ranges ``[a, b)``) and, if asked for, the ``kept`` words joined by blanks."""
    scratch = Scratch(docs.sparkSession, "substrings")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = texts.mapInArrow(_packer(chunk_bytes), f"ids array<{kind}>, data binary, offsets binary, bytes long")
    # The number of a chunk is fixed once the table is written; row groups are small, as chunks are read whole.
    chunks = scratch.put(packed.select(F.monotonically_increasing_id().alias("chunk"), "ids", "data", "offsets", "bytes"), "chunks", options={"parquet.block.size": 8 * chunk_bytes})
    buckets = max(1, -(-(chunks.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes))
    bodies = chunks.select("chunk", "data", "offsets", "bytes")
    sent = bodies.mapInArrow(_sender(buckets, chunk_bytes), "bucket long, chunk long, entries binary")
    hits = scratch.put(sent.groupBy("bucket").applyInArrow(_match, _HITS), "hits")
    scratch.release()
    told = hits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "hits")).alias("told"))
    found = scratch.put(bodies.join(told, "chunk").mapInArrow(_extender(buckets, chunk_bytes), _EXTENSIONS), "extensions")
    scratch.drop("hits")
    scratch.release()
    kinds = scratch.put(found.groupBy("anchor", "words").agg(F.sum("times").alias("times"), F.first("windows").alias("windows")), "kinds")
    each = kinds.select("anchor", "words", "times", F.posexplode("windows").alias("k", "window"))
    # Of the windows that occur again, those that an extension without equal needs.
    again = each.groupBy("anchor", "window").agg(F.sum("times").alias("all"), F.min("times").alias("least")).where("all > 1 AND least = 1")
    again = scratch.put(again.select("anchor", "window"), "again")
    parts = each.where("times = 1").join(again, ["anchor", "window"]).groupBy("anchor", "words").agg(F.expr("bit_or(shiftleft(1, k))").alias("mask"))
    verdicts = kinds.where("times > 1").select("anchor", "words", F.lit(-1).alias("mask")).unionByName(parts)
    # A full mask covers the windows that the extension has.
    whole = F.expr("IF(mask = -1, shiftleft(1, size(windows)) - 1, mask)")
    marks = found.join(scratch.put(verdicts, "verdicts"), ["anchor", "words"]).select("chunk", F.struct("places", whole.alias("mask")).alias("told"))
    marks = scratch.put(marks.groupBy("chunk").agg(F.collect_list("told").alias("told")), "marks")
    scratch.drop("extensions", "kinds", "again", "verdicts")
    scratch.release()
    out = f"id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<a:long,b:long>>" + ", kept string" * with_text
    whole = chunks.select("chunk", "ids", "data", "offsets", "bytes").join(marks, "chunk", "left")
    return whole.mapInArrow(_remover(chunk_bytes, with_text), out).withColumnRenamed("id", id_col)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The contract read literally, for tests."""
    words = [(text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") for _, text in docs]
    words = [[w for w in ws if w] for ws in words]
    seen: dict[tuple, list[tuple[int, int]]] = {}
    for d, ws in enumerate(words):
        for i in range(len(ws) - WINDOW + 1):
            seen.setdefault(tuple(ws[i : i + WINDOW]), []).append((d, i))
    gone: list[set[int]] = [set() for _ in docs]
    for spots in seen.values():
        for d, i in spots if len(spots) > 1 else ():
            gone[d].update(range(i, i + WINDOW))
    kept = [" ".join(w for i, w in enumerate(ws) if i not in gone[d]) for d, ws in enumerate(words)]
    return [(doc[0], len(words[d]), len(gone[d]), hashlib.sha256(kept[d].encode()).hexdigest()) for d, doc in enumerate(docs)]
