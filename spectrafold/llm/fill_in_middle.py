"""Fill-in-the-middle by piece tables.

A document is never copied: it is a list of descriptors ``(buffer, start,
length)`` over immutable buffers, its own text and one buffer for each
sentinel, in code points.  Cutting splits the one descriptor of the text at two
places drawn from the document's id; an arrangement puts the three parts and
the sentinels in the order of its form; the inverse arrangement drops the
sentinels and restores the order.  ``render`` makes the text of a list of
descriptors; ``stream_digests`` hashes descriptors one after the other from the
buffers' bytes, so that no arranged text is built.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>``
suffix ``<P>`` prefix ``<M>`` middle, ``plain`` is the text itself.  Draws are the
first four groups of eight digits of the hex SHA-256 of ``1:`` and the decimal
id, so they hold on every machine and for every retry.

Everything is a map over rows, without a shuffle.  Descriptors are computed by
DataFrame functions; a Python worker holds one batch of texts and, for texts
with characters beyond ASCII, a mark for each byte of one text.

Defined results: a null text is empty; empty texts and texts that hold a
sentinel are plain; a null id draws as an empty string; rows that share an id
are cut by the same draws; cuts may fall on the ends and on each other, which
gives parts without characters; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm._store import bounded_batches

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Parts of the text and sentinels in the order of each form.
FORMS = {"psm": (PREFIX, "prefix", SUFFIX, "suffix", MIDDLE, "middle"), "spm": (SUFFIX, "suffix", PREFIX, "prefix", MIDDLE, "middle")}
PLAIN_FROM, SPM_BELOW = 90, 20
_BLOCK = 1 << 16


def draws(id_col: Column) -> list[Column]:
    """Four unsigned integers of 32 bits from an id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _piece(buffer: str, start: Column, length: Column) -> Column:
    return F.struct(F.lit(buffer).alias("buffer"), start.cast("long").alias("start"), length.cast("long").alias("length"))


def arrange(form: str, parts: dict[str, Column]) -> Column:
    """Descriptors of the output of one form from those of the three parts."""
    return F.array(*[parts[x] if x in parts else _piece(x, F.lit(0), F.lit(len(x))) for x in FORMS[form]])


def restore_pieces(pieces: Column, form: Column) -> Column:
    """Descriptors of the original text: the parts of an output in the order prefix, middle, suffix."""
    at = {f: [order.index(x) for x in ("prefix", "middle", "suffix")] for f, order in FORMS.items()}
    back = {f: F.array(*[F.get(pieces, F.lit(k)) for k in places]) for f, places in at.items()}
    return F.when(form == "psm", back["psm"]).when(form == "spm", back["spm"]).otherwise(pieces)


def piece_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``text`` (the buffer), n, form, prefix_chars, middle_chars, ``pieces`` of the output and ``restored`` pieces."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("id"))
    rows = rows.withColumns({"n": F.length("text").cast("long"), "h1": h1, "h2": h2, "h3": h3, "h4": h4})
    held = F.lit(False)
    for sentinel in SENTINELS:
        held = held | F.contains("text", F.lit(sentinel))
    plain = (F.col("n") == 0) | (F.pmod("h3", F.lit(100)) >= PLAIN_FROM) | held
    one, two = F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1)
    rows = rows.withColumns({"form": F.when(plain, F.lit("plain")).when(F.pmod("h4", F.lit(100)) < SPM_BELOW, F.lit("spm")).otherwise(F.lit("psm")), "a": F.least(one, two), "b": F.greatest(one, two)})
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    parts = {"prefix": _piece("text", F.lit(0), a), "middle": _piece("text", a, b - a), "suffix": _piece("text", b, n - b)}
    pieces = F.when(F.col("form") == "psm", arrange("psm", parts)).when(F.col("form") == "spm", arrange("spm", parts)).otherwise(F.array(_piece("text", F.lit(0), n)))
    cut = F.col("form") != "plain"
    rows = rows.select(F.col("id").alias(id_col), "text", "n", "form", F.when(cut, a).alias("prefix_chars"), F.when(cut, b - a).alias("middle_chars"), pieces.alias("pieces"))
    return rows.withColumn("restored", restore_pieces(F.col("pieces"), F.col("form")))


def render(pieces: Column, text: Column) -> Column:
    """The text that descriptors stand for."""
    said = F.transform(pieces, lambda p: F.when(p["buffer"] == "text", F.substring(text, (p["start"] + 1).cast("int"), p["length"].cast("int"))).otherwise(p["buffer"]))
    return F.array_join(said, "")


def restore_text(output: Column, form: Column) -> Column:
    """The original text from an output as text: its sentinels bound the parts, which the form names."""
    part = lambda s, e: F.regexp_extract(output, f"(?s){s}(.*?){e}", 1)
    suffix = F.when(form == "psm", part(SUFFIX, MIDDLE)).otherwise(part(SUFFIX, PREFIX))
    prefix = F.when(form == "psm", part(PREFIX, SUFFIX)).otherwise(part(PREFIX, MIDDLE))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part(MIDDLE, r"\z"), suffix))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Training texts: the id, form, ``pieces`` and the arranged ``output``."""
    tables = piece_tables(docs, id_col, text_col)
    return tables.select(id_col, "n", "form", "prefix_chars", "middle_chars", "pieces", render(F.col("pieces"), F.col("text")).alias("output"))


class _Places:
    """Byte places of the code points of one UTF-8 text."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.heads = None
        if self.n and data.max() >= 0x80:
            self.heads = (data & 0xC0) != 0x80
            self.before = np.r_[0, np.cumsum([int(self.heads[i : i + _BLOCK].sum()) for i in range(0, self.n, _BLOCK)])]

    def of(self, k: int) -> int:
        if self.heads is None:
            return k
        if k >= self.before[-1]:
            return self.n
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        return block * _BLOCK + int(np.flatnonzero(self.heads[block * _BLOCK : (block + 1) * _BLOCK])[k - int(self.before[block])])


def _hasher(lists: int):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for row, text in enumerate(batch.column(1)):
                raw = text.as_buffer()
                places, view = _Places(np.frombuffer(raw, dtype=np.uint8)), memoryview(raw)
                out = []
                for column in range(2, 2 + lists):
                    sha = hashlib.sha256()
                    for buffer, start, length in (p.values() for p in batch.column(column)[row].as_py()):
                        sha.update(view[places.of(start) : places.of(start + length)] if buffer == "text" else buffer[start : start + length].encode())
                    out.append(sha.hexdigest())
                ends.append(out)
            sums = [pa.array([x[k] for x in ends], pa.string()) for k in range(lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], names=["kept", *[f"sha{k}" for k in range(lists)]])

    return digest


def stream_digests(tables: DataFrame, lists: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, for each ``name: column of descriptors``, the lower-case hex SHA-256 of what they stand for in UTF-8."""
    bounded_batches(tables.sparkSession)
    flat = lambda c: F.transform(c, lambda p: F.struct(p["buffer"], p["start"], p["length"]))
    source = tables.select(F.struct(*keep).alias("kept"), "text", *[flat(c).alias(f"list{k}") for k, c in enumerate(lists.values())])
    kind = source.schema["kept"].dataType.simpleString()
    found = source.mapInArrow(_hasher(len(lists)), f"kept {kind}, " + ", ".join(f"sha{k} string" for k in range(len(lists))))
    return found.select("kept.*", *[F.col(f"sha{k}").alias(name) for k, name in enumerate(lists)])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = piece_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return stream_digests(tables, {"output_sha256": "pieces", "restored_sha256": "restored"}, ["doc_id", "n", "form", "prefix_chars", "middle_chars"])


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS p, ('0x' || x[9:16])::BIGINT % (n + 1) AS q, ('0x' || x[17:24])::BIGINT % 100 AS r, ('0x' || x[25:32])::BIGINT % 100 AS s FROM d),
c AS (SELECT *, least(p, q) AS a, greatest(p, q) AS b,
  CASE WHEN n = 0 OR r >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
  WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1, n - b) || '<M>' || substring(t, a + 1, b - a)
  ELSE '<S>' || substring(t, b + 1, n - b) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS out FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out
    WHEN 'psm' THEN substring(out, 4, instr(out, '<S>') - 4) || substring(out, instr(out, '<M>') + 3) || substring(out, instr(out, '<S>') + 3, instr(out, '<M>') - instr(out, '<S>') - 3)
    ELSE substring(out, instr(out, '<P>') + 3, instr(out, '<M>') - instr(out, '<P>') - 3) || substring(out, instr(out, '<M>') + 3) || substring(out, 4, instr(out, '<P>') - 4) END) AS restored_sha256
FROM o
"""


def brute_force(doc_id: int | None, text: str | None) -> tuple:
    """One row of the contract, read literally, for tests."""
    text = text or ""
    n, x = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, a, b - a, sha(output), sha(text)
