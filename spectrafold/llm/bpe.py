"""Byte-level BPE by speculation and verification.

Texts are cut into words (matches of the pre-tokenizer's pattern) all at once, by
classes of code points.  A word is first cut greedily into the
longest vocabulary entries.  That guess is what BPE yields exactly when each
token forms by itself and no adjacent pair would have been merged across its
border earlier; both are tested for all words of a batch at once, with numpy.
Only words that fail are merged rank by rank.  Words are memoised per Python
worker in arrays of bounded size, by a 64-bit hash, so frequent words cost one
lookup.  Texts are handled in runs of ``RUN`` characters; a longer text is cut
before white space that follows another character, where a word ends anyway.

The work is a map over rows without a shuffle.  The vocabulary file is read on
the driver (its path is a parameter) and broadcast; its size is fixed by the
tokenizer and does not depend on the data.

Defined results: null and empty texts give no ids and decode to the empty
text; repeated rows each get a row; special tokens' strings in a text become
their ids; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._store import bounded_batches
from spectrafold.llm._text import _Powers, mix

#: Unicode white space as the tokenizers library sees it (Python's own class holds four control characters more).
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Words memoised per Python worker, at some 50 bytes each; the memo starts anew beyond that.
MEMO_WORDS = 500_000
#: Bytes beyond which a word that fails is merged on its own.
LONG_WORD = 64
#: Characters handled in step.
RUN = 512 << 10
_NEVER = np.iinfo(np.int64).max
_LETTER, _NUMBER, _BLANK = 1, 2, 3
_CUT = regex.compile(rf"(?<=[^{_SPACE}])[{_SPACE}]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _kinds() -> np.ndarray:
    """The class of every code point; 0 is none of the others."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), dtype=np.uint8)
    for kind, said in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, f"[{_SPACE}]+")):
        for m in regex.finditer(said, every):
            out[m.start() : m.end()] = kind
    return out


def word_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in texts that lie one after the other; ``first`` holds where texts begin."""
    n, kind = len(codes), _kinds()[codes]
    begins = np.zeros(n + 1, dtype=bool)
    begins[first] = True
    begins[n] = True
    change = begins[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    end = np.r_[run[1:], n]
    blank = kind[run] == _BLANK
    out = np.zeros(n + 3, dtype=bool)
    # White space before a word leaves its last character to it, if that is a blank, or else by itself.
    out[run] = True
    before = blank & ~begins[end]
    out[end[before] - 1] = True
    joined = end[before][codes[end[before] - 1] == 0x20]
    out[joined] = False
    # Contractions: an apostrophe of its own before certain letters.
    mark = run[(codes[run] == 0x27) & (end - run == 1) & out[run] & ~begins[end]]
    pad = np.r_[codes, 0, 0, 0]
    inside = np.r_[(kind == _LETTER) & ~begins[:-1], False, False, False]
    mark = mark[inside[mark + 1]]
    one, two = pad[mark + 1], pad[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    pair = ~short & inside[mark + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for some, size in ((mark[short], 2), (mark[pair], 3)):
        out[some + 1] = False
        rest = some + size
        out[rest[inside[rest]]] = True
    return np.flatnonzero(out[:n])


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file, as plain arrays."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        size = max([*named.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in named.items():
            self.pieces[i] = piece
        for said, i in self.special.items():
            self.pieces[i] = said.encode()
        self.ids = named
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.born = np.full(size, -1, dtype=np.int64)
        codes, ranks, made = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = (named[raw(s)] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = named[self.pieces[a] + self.pieces[b]]
            codes.append(a * size + b)
            ranks.append(rank)
            made.append(whole)
            if self.born[whole] < 0:
                self.born[whole], self.left[whole], self.right[whole] = rank, a, b
        order = np.argsort(codes)
        self.codes, self.ranks = np.array(codes, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order]
        self.merges = dict(zip(codes, zip(ranks, made)))
        self.made = np.array(made, dtype=np.int64)
        self.byte_ids = np.array([named[bytes((b,))] for b in range(256)], dtype=np.int64)
        self.size = size
        self._grow_trie(named)
        # A token whose own halves don't stay whole until it forms never comes out of merging.
        built = np.flatnonzero(self.born >= 0)
        sound = self._keeps(self.left[built], self.right[built], self.born[built])
        self.sound = np.zeros(size, dtype=bool)
        self.sound[[i for p, i in named.items() if len(p) == 1]] = True
        good = dict(zip(built.tolist(), sound.tolist()))
        for t in built[np.argsort(self.born[built])].tolist():
            self.sound[t] = good[t] and self.sound[self.left[t]] and self.sound[self.right[t]]

    def _grow_trie(self, named: dict[bytes, int]) -> None:
        """Prefixes of tokens as numbered nodes, with the token that ends at each, and steps between them in a sparse table."""
        nodes, ends, steps = {b"": 0}, [-1], []
        for piece, i in named.items():
            at = 0
            for k in range(1, len(piece) + 1):
                code = at << 8 | piece[k - 1]
                at = nodes.setdefault(piece[:k], len(nodes))
                if at == len(ends):
                    ends.append(-1)
                    steps.append((code, at))
            ends[at] = i
        self.ends = np.array(ends, dtype=np.int64)
        codes, targets = np.array(steps, dtype=np.int64).T
        self.step_bits = int(len(codes) * 4).bit_length()
        self.step_code, self.step_to = np.full(1 << self.step_bits, -1, dtype=np.int64), np.full(1 << self.step_bits, -1, dtype=np.int64)
        slot, left = self._slot(codes), np.arange(len(codes))
        while len(left):  # of codes that meet in a slot one takes it, the others move on
            free = left[self.step_code[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            took = free[one]
            self.step_code[slot[took]], self.step_to[slot[took]] = codes[took], targets[took]
            left = np.setdiff1d(left, took, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.step_bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.step_bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that a byte leads to, or -1."""
        codes = node << 8 | byte
        slot = self._slot(codes)
        out, found = self.step_to[slot], self.step_code[slot]
        out[found != codes] = -1
        far = np.flatnonzero((found != codes) & (found >= 0))
        while len(far):
            slot[far] = (slot[far] + 1) & ((1 << self.step_bits) - 1)
            found = self.step_code[slot[far]]
            hit = found == codes[far]
            out[far[hit]] = self.step_to[slot[far[hit]]]
            far = far[~hit & (found >= 0)]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], _NEVER)

    def _keeps(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether nothing merges across the border of a and b before ``until``.

        Going back in time, the pieces beside the border are the right spine of
        a and the left spine of b; each lives from the rank that makes it to the
        rank that uses it.  A merge across is possible at a rank within both lives.
        On a tie the leftmost place merges first.
        """
        x, y = a.copy(), b.copy()
        x_used = np.broadcast_to(np.asarray(until, dtype=np.int64), a.shape).copy()
        y_used = x_used.copy()
        y_tie = np.full(a.shape, until is not _NEVER)  # the pair itself merges at ``until``: no conflict
        fine = np.ones(a.shape, dtype=bool)
        live = np.arange(len(a))
        while len(live):
            lx, ly = x[live], y[live]
            rank = self._rank(lx, ly)
            clash = (rank < x_used[live]) & np.where(y_tie[live], rank < y_used[live], rank <= y_used[live]) & (rank != _NEVER)
            fine[live[clash]] = False
            born_x, born_y = self.born[lx], self.born[ly]
            go = ~clash & ((born_x >= 0) | (born_y >= 0))
            live, lx, ly, born_x, born_y = (v[go] for v in (live, lx, ly, born_x, born_y))
            back_x = born_x >= born_y
            i, j = live[back_x], live[~back_x]
            x_used[i], x[i] = born_x[back_x], self.right[lx[back_x]]
            y_used[j], y[j] = born_y[~back_x], self.left[ly[~back_x]]
            y_tie[j] = False
        return fine


class Codec:
    """Encodes and decodes with one vocabulary; lives in a Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        said = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, said)) + ")") if said else None
        self.merged = 0
        self._forget()

    def _forget(self) -> None:
        """An empty memo: sorted hashes of words, where their ids begin in ``flat``, and how many they are."""
        self.keys, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _guess(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words in step: ids, word by word, and the word of each."""
        word, at = np.arange(len(begin)), begin.copy()
        stop, node, last, last_end = end, np.zeros(len(begin), dtype=np.int64), np.full(len(begin), -1), begin.copy()
        ids, owner = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        data = np.r_[data, np.zeros(1, dtype=np.uint8)].astype(np.int64)
        while len(word):
            to = self.v.step(node, data[at])
            to[at >= stop] = -1
            on = to >= 0
            node = np.where(on, to, 0)
            at = at + on
            token = self.v.ends[node]
            whole = on & (token >= 0)
            last, last_end = np.where(whole, token, last), np.where(whole, at, last_end)
            off = np.flatnonzero(~on)
            if len(off):
                ids.append(last[off])
                owner.append(word[off])
                at[off] = last_end[off]
                last[off] = -1
                done = off[at[off] >= stop[off]]
                if len(done):
                    live = np.ones(len(word), dtype=bool)
                    live[done] = False
                    word, at, stop, node, last, last_end = (x[live] for x in (word, at, stop, node, last, last_end))
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def _merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words in step.

        In each round every word merges its lowest-ranked pair at all its places,
        leftmost first where places overlap; words without a pair left are done.
        Words over ``LONG_WORD`` bytes go through a heap instead.
        """
        out: list[list[int]] = [[] for _ in words]
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._merge_long([self.v.ids[w[k : k + 1]] for k in range(len(w))])
        if not short:
            return out
        sizes = np.array([len(words[i]) for i in short])
        sym = self.v.byte_ids[np.frombuffer(b"".join(words[i] for i in short), dtype=np.uint8)]
        owner = np.repeat(np.array(short), sizes)
        rank = np.full(len(sym), _NEVER)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        rank[pair] = self.v._rank(sym[pair], sym[pair + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            done = least == _NEVER
            if done.any():
                ends = np.flatnonzero(done[starts])
                flat = sym[done].tolist()
                at = 0
                for w, k in zip(owner[starts[ends]].tolist(), sizes[ends].tolist()):
                    out[w] = flat[at : at + k]
                    at += k
                live = ~done
                sym, owner, rank, least = sym[live], owner[live], rank[live], least[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            # Of places that overlap (a run of one symbol), every second one merges.
            run = np.r_[0, np.cumsum(np.diff(hit) != 1)]
            first = np.r_[True, run[1:] != run[:-1]]
            offset = np.arange(len(hit)) - np.flatnonzero(first)[run]
            hit = hit[offset % 2 == 0]
            sym[hit] = self.v.made[rank[hit]]
            gone = np.zeros(len(sym), dtype=bool)
            gone[hit + 1] = True
            place = np.cumsum(~gone) - 1
            keep = ~gone
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at = place[hit]
            near = np.unique(np.r_[at, at[at > 0] - 1])
            last = near == len(sym) - 1
            rank[near[last]] = _NEVER
            near = near[~last]
            same = owner[near] == owner[near + 1]
            rank[near[~same]] = _NEVER
            near = near[same]
            rank[near] = self.v._rank(sym[near], sym[near + 1])
        return out

    def _merge_long(self, out: list[int]) -> list[int]:
        """Exact merging of one word by a heap over a linked list."""
        import heapq

        size, merges, n = self.v.size, self.v.merges, len(out)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, out[i], out[i + 1], m[1]) for i in range(n - 1) if (m := merges.get(out[i] * size + out[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if out[i] != a or j >= n or out[j] != b:
                continue
            out[i], out[j] = whole, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get(whole * size + out[after[i]]):
                    heapq.heappush(heap, (m[0], i, whole, out[after[i]], m[1]))
            if (k := before[i]) >= 0 and (m := merges.get(out[k] * size + whole)):
                heapq.heappush(heap, (m[0], k, out[k], whole, m[1]))
        return [t for t in out if t >= 0]

    def learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, word by word, and how many each has: guess all, verify all pairs at once, merge those that fail."""
        flat, owner = self._guess(data, begin, end)
        bad = np.zeros(len(begin), dtype=bool)
        bad[owner[~self.v.sound[flat]]] = True
        inner = owner[1:] == owner[:-1]
        a, b = flat[:-1][inner], flat[1:][inner]
        pairs, which = np.unique(a * self.v.size + b, return_inverse=True)
        keeps = self.v._keeps(pairs // self.v.size, pairs % self.v.size)
        bad[owner[1:][inner][~keeps[which]]] = True
        failed = np.flatnonzero(bad)
        self.merged += len(failed)
        raw = data.tobytes()
        merged = self._merge([raw[x:y] for x, y in zip(begin[failed].tolist(), end[failed].tolist())])
        fine = ~bad[owner]
        again = np.repeat(failed, [len(m) for m in merged])
        flat = np.r_[flat[fine], np.fromiter(chain.from_iterable(merged), dtype=np.int64, count=len(again))]
        owner = np.r_[owner[fine], again]
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(begin))

    def _remember(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.r_[self.flat, ids.astype(np.int32)]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after the other, and how many each has."""
        said = "".join(texts)
        if not said:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        codes = np.frombuffer(said.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        edge = np.r_[0, np.cumsum(size)]
        start = word_starts(codes, edge[:-1][size > 0])
        end = np.r_[start[1:], len(codes)]
        up, down = _Powers.upto(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        keys, one, which = np.unique(mix((sums[end] - sums[start]) * down[start]), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMO_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        met = at < len(self.keys)
        new[met] = self.keys[at[met]] != keys[met]
        if new.any():
            data = np.frombuffer(said.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            place = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # of each character's first byte
            self._remember(keys[new], *self.learn(data, place[start[one[new]]], place[end[one[new]]]))
            at = np.searchsorted(self.keys, keys)
        begin, count = self.begin[at][which], self.size[at][which]
        total = np.r_[0, np.cumsum(count)]
        ids = self.flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, edge)])

    def _parts(self, text: str) -> Iterator[str | int]:
        """Ids of special tokens, and what lies between them in pieces of bounded length."""
        if self.special is not None and any(s in text for s in self.v.special):
            for i, part in enumerate(self.special.split(text)):
                if i % 2:
                    yield self.v.special[part]
                elif part:
                    yield from _pieces(part)
        else:
            yield from _pieces(text)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        out, counts = [np.zeros(0, dtype=np.int32)], np.zeros(len(texts), dtype=np.int64)
        held, owner, size = [], [], 0

        def flush():
            nonlocal held, owner, size
            if held:
                ids, n = self._run(held)
                out.append(ids)
                np.add.at(counts, owner, n)
            held, owner, size = [], [], 0

        for i, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                if isinstance(part, int):
                    flush()
                    out.append(np.array([part], dtype=np.int32))
                    counts[i] += 1
                else:
                    held.append(part)
                    owner.append(i)
                    size += len(part)
                    if size >= RUN:
                        flush()
        flush()
        return np.concatenate(out), counts

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        flat, counts = self.encode_flat(texts)
        return [ids.tolist() for ids in np.split(flat, np.cumsum(counts)[:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > RUN and (cut := _CUT.search(text, at + RUN)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec per Python worker and broadcast, so that its memo outlives a task."""
    key = shared._jbroadcast_id if hasattr(shared, "_jbroadcast_id") else id(shared.value)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def _groups(texts: list[str | None], limit: int = RUN) -> Iterator[list[str | None]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t or "")
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id and ``ids array<int>``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1).to_pylist()):
                flat, counts = codec.encode_flat(group)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), ids], names=[id_col, "ids"])
                at += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: its id and the decoded ``text``."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass, so that no ids leave the Python worker."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        said = list(map(str, range(codec.v.size)))
        for batch in batches:
            counts, coded, decoded = [], [], []
            for group in _groups(batch.column(1).to_pylist()):
                flat, sizes = codec.encode_flat(group)
                counts += sizes.tolist()
                for ids in np.split(flat, np.cumsum(sizes)[:-1]):
                    ids = ids.tolist()
                    coded.append(hashlib.sha256(",".join(map(said.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary(name: str = "byte_bpe_50k.json") -> Vocabulary:
    import public_tokenizers

    return load_vocabulary(public_tokenizers.path(name))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
