"""Token ids packed into fixed-length rows by best-fit decreasing.

Documents become token ids and one end mark each; a document longer than a row
is cut into full rows and a rest, with nothing lost.  Pieces are dealt to
packing groups by a hash of document id and piece, the number of groups
following the total number of tokens, so a group has about ``GROUP_TOKENS``
tokens at any size of the corpus and the result does not depend on how the
input is partitioned.  In a group, pieces go in falling order of length each
into the fullest row that still holds them; a segment tree over free room finds
it in logarithmic time.

Each packed row has its ids (little-endian 16- or 32-bit matrix row, padded),
cumulative segment lengths, and position ids that restart at each segment, with
the document and piece of each segment.  ``unpack`` restores the documents.

Defined results: null and empty texts give a document of the end mark alone;
rows that repeat an id are separate documents of that id, told apart by ``copy``,
a hash of the text, so that rows equal in both come back as equal pieces; ids may
be of any type, and null; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._store import Scratch
from spectrafold.llm.bpe import Vocabulary, _codec, _groups, public_vocabulary

ROW_TOKENS = 2048
GROUP_TOKENS = 1_000_000
PACKED = "pack_group int, row int, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<{}>, copies array<long>, pieces array<int>"


class Rooms:
    """Counts of open rows by free room, with a segment tree for the least room of at least a size."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of the fullest row with room for ``need``."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at % 2 or not self.tree[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.tree[at] -= 1
            at //= 2
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The row of each piece, pieces given in falling order of length."""
    rooms, out, rows = Rooms(capacity), [], 0
    for n in lengths:
        got = rooms.take(n)
        row, room = got if got else (rows, capacity)
        rows += got is None
        out.append(row)
        if room > n:
            rooms.add(room - n, row)
    return out


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, copy, piece, n_tokens, ids)``: each document's ids and end mark, cut at ``capacity``; ids are packed little-endian."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = np.dtype("<u2" if vocabulary.size <= 1 << 16 else "<u4")
    end = next(iter(vocabulary.special.values()), vocabulary.size - 1)

    width = kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(2).to_pylist()):
                flat, counts = codec.encode_flat(group)
                stop = np.cumsum(counts + 1)
                ids = np.full(int(stop[-1]), end, dtype=kind)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(group)), counts)] = flat
                parts = -(-(counts + 1) // capacity)
                doc = np.repeat(np.arange(len(group)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                begin = (stop - counts - 1)[doc] + piece * capacity
                size = np.minimum(stop[doc] - begin, capacity)
                cut = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((np.r_[begin, stop[-1]] * width).astype(np.int32)), pa.py_buffer(ids)])
                own = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32)), cut], names=["doc_id", "copy", "piece", "n_tokens", "ids"])
                at += len(group)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("copy"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, copy long, piece int, n_tokens int, ids binary")


def _packer(capacity: int, width: int, end: int):
    kind = np.dtype(f"<u{width}")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "copy", "piece", "doc_id"], ascending=[False, True, True, True], kind="stable")
        group = int(part["pack_group"].iloc[0])
        place = np.array(best_fit(part["n_tokens"].tolist(), capacity))
        order = np.argsort(place, kind="stable")
        part, place = part.iloc[order], place[order]
        cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
        sizes, docs, copies, parts, ids = (part[c].to_numpy() for c in ("n_tokens", "doc_id", "copy", "piece", "ids"))
        out = []
        for a, b in zip(cut, cut[1:]):
            n = int(sizes[a:b].sum())
            pad = np.full(capacity - n, end, dtype=kind).tobytes()
            ends = [0, *np.cumsum(sizes[a:b]).tolist()]
            positions = np.zeros(capacity, dtype=kind)
            positions[:n] = np.concatenate([np.arange(s, dtype=kind) for s in sizes[a:b]])
            out.append((group, int(place[a]), b"".join(ids[a:b]) + pad, n, ends, positions.tobytes(), docs[a:b].tolist(), copies[a:b].tolist(), parts[a:b].tolist()))
        return pd.DataFrame(out, columns=["pack_group", "row", "ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "copies", "pieces"])

    return run


def pack(docs: DataFrame, vocabulary: Vocabulary, capacity: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows, as ``PACKED`` says."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.put(pieces(docs, vocabulary, capacity, id_col, text_col), "pieces", 1000)
    total = cut.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(groups)).cast("int"))
    end = next(iter(vocabulary.special.values()), vocabulary.size - 1)
    return dealt.groupBy("pack_group").applyInPandas(_packer(capacity, 2 if vocabulary.size <= 1 << 16 else 4, end), PACKED.format(cut.schema["doc_id"].dataType.simpleString()))


def unpack(packed: DataFrame, width: int = 2) -> DataFrame:
    """``(doc_id, copy, piece, ids)`` of every segment, cut out of the rows again; a document's pieces in order are its ids."""
    each = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "copies", "pieces")).alias("k", "s"))
    start, stop = F.col("cu_seqlens")[F.col("k")], F.col("cu_seqlens")[F.col("k") + 1]
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.copies").alias("copy"), F.col("s.pieces").alias("piece"), F.substring("ids", start * width + 1, (stop - start) * width).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
