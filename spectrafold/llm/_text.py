"""Vectorised word splitting and hashing over Arrow string batches.

Texts are handled as one byte buffer: a lookup table marks word bytes, their
edges give the words, and a prefix sum of a polynomial gives every word's
64-bit hash without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 512 << 10


def byte_class(stops: str) -> np.ndarray:
    """True for bytes that belong to words; ``stops`` lists the separator characters (ASCII)."""
    table = np.ones(256, dtype=bool)
    table[[ord(c) for c in stops]] = False
    return table


#: words of ``[^\x20\x09-\x0D]+``
SPACED = byte_class(" \t\n\x0b\x0c\r")
#: words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """``base**i`` and its inverse, grown on demand and kept per Python worker."""

    up = np.ones(1, dtype=_U)
    down = np.ones(1, dtype=_U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            cls.up = np.cumprod(np.r_[_U(1), np.full(size - 1, _BASE)], dtype=_U)
            cls.down = np.cumprod(np.r_[_U(1), np.full(size - 1, _INVERSE)], dtype=_U)
        return cls.up, cls.down


@dataclass
class Words:
    """Words of a run of texts. ``doc[i]`` is the text of word i, ``first[d]:first[d+1]`` the words of text d."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True) -> Words:
    """``data`` holds the bytes of all texts; text d is ``data[offsets[d]:offsets[d+1]]``.  ``fold`` lower-cases A-Z."""
    n = len(offsets) - 1
    low = _LOWER[data] if fold else data
    inside = table[low]
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(low, none, none, none, np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=_U))
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[tails] = inside[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n), np.diff(first))
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((low.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    return Words(low, start, end, doc, first, mix((sums[end] - sums[start]) * down[start]))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``limit`` bytes: (from, to, bytes, offsets).

    Nulls count as empty.  A text over the limit forms a run of its own.
    """
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``size``-word shingles, with the text of each; a shorter text is one shingle."""
    h, n = words.hash, len(words.hash)
    counts = np.diff(words.first)
    if n >= size:
        total = np.zeros(n - size + 1, dtype=_U)
        for k in range(size):
            total = total * _BASE + h[k : n - size + 1 + k]
        whole = words.doc[: n - size + 1] == words.doc[size - 1 :]
        out, doc = mix(total[whole]), words.doc[: n - size + 1][whole]
    else:
        out, doc = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        values = []
        for d in short:
            total = _U(counts[d])
            for k in range(words.first[d], words.first[d + 1]):
                total = _U((int(total) * int(_INVERSE) + int(h[k])) & 0xFFFFFFFFFFFFFFFF)
            values.append(total)
        out = np.concatenate([out, mix(np.array(values, dtype=_U))])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc
