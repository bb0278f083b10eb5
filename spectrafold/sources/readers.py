"""Table readers by format, text parsers for scientific files, and sinks.

Readers pick a format from the suffix or from a file's first bytes, read with
Spark's own sources, and push column choices into the scan.  Parsers turn text
files into rows with DataFrame expressions, so large files are split as usual.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes that may be read, and the format of each.
FORMATS = {".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".orc": "orc", ".xml": "xml"}
SEPARATORS = (",", "\t", ";", "|")


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    name = name[:-3] if name.endswith(".gz") else name
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator that occurs equally often, and most, in the first lines; else the suffix's own."""
    head = [r.value for r in spark.read.text(path).limit(20).collect()]
    counts = {s: [line.count(s) for line in head if line] for s in SEPARATORS}
    steady = {s: n[0] for s, n in counts.items() if n and n[0] > 0 and min(n) == max(n)}
    if steady:
        return max(steady, key=steady.get)
    return "\t" if _suffix(path) in (".tsv", ".txt") else ","


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """Any supported table, with only the columns asked for and at most ``rows`` rows."""
    kind = FORMATS.get(_suffix(path)) or _sniff(spark, path)
    if kind == "csv":
        df = spark.read.csv(path, header=True, inferSchema=True, sep=detect_separator(spark, path))
    elif kind == "json":
        df = spark.read.json(path, multiLine=True)
    elif kind == "jsonl":
        df = spark.read.json(path)
    elif kind == "xml":
        df = spark.read.format("xml").option("rowTag", "row").load(path)
    elif kind in ("parquet", "orc"):
        df = spark.read.format(kind).load(path)
    else:
        raise ValueError(f"unsupported file format: {path}")
    df = df.select(*[c for c in columns if c in df.columns]) if columns is not None else df
    return df.limit(rows) if rows is not None else df


def _sniff(spark: SparkSession, path: str) -> str | None:
    """The format by a file's first bytes, of which no more are read; of a folder, its first data file's."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    if fs.getFileStatus(where).isDirectory():
        files = [f.getPath() for f in fs.listStatus(where) if f.isFile() and f.getPath().getName()[0] not in "._"]
        if not files:
            return None
        where = min(files, key=lambda f: f.getName())
    stream = fs.open(where)
    try:
        magic = bytes(b for b in (stream.read() for _ in range(4)) if b >= 0)
    finally:
        stream.close()
    return "parquet" if magic == b"PAR1" else "orc" if magic[:3] == b"ORC" else None


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names without reading the data."""
    if FORMATS.get(_suffix(path)) == "csv":
        return spark.read.csv(path, header=True, sep=detect_separator(spark, path)).columns
    return read_table(spark, path).columns


def guarded_read(spark: SparkSession, path: str, roots: Sequence[str]) -> DataFrame:
    """A table under one of the allowed roots, tagged with where it came from."""
    if ".." in path.split("/") or not any(path.startswith(r.rstrip("/") + "/") for r in roots):
        raise PermissionError(f"{path} is outside the allowed roots")
    return read_table(spark, path).withColumn("source", F.lit(path))


def synthetic(spark: SparkSession, n: int, groups: Sequence[str] = ("control", "treatment"), effect: float = 1.0, seed: int = 42) -> DataFrame:
    """Seeded rows with a group, whose mean is the effect times its place, and a normal value."""
    names = F.array(*[F.lit(g) for g in groups])
    k = (F.col("id") % len(groups)).cast("int")
    return spark.range(n).select("id", F.element_at(names, k + 1).alias("group"), (k * effect + F.randn(seed)).alias("value"), F.lit("synthetic").alias("source"))


def parse_size(text: Column) -> Column:
    """Bytes from sizes such as ``587M``."""
    number, unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([KMGT]?)i?B?\s*$", 1), F.upper(F.regexp_extract(text, r"^\s*([0-9.]+)\s*([KMGTkmgt]?)i?[Bb]?\s*$", 2))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(F.length(number) > 0, F.floor(number.try_cast("double") * F.pow(F.lit(1024.0), power)))


def parse_reference(text: Column) -> Column:
    """``scheme://locator#selector`` as a struct; NULL where it is none."""
    pattern = r"^([a-z][a-z0-9+.-]*)://([^#]+)(?:#(.*))?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("scheme"), part(2).alias("locator"), F.nullif(part(3), F.lit("")).alias("selector")))


def series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(feature, sample, value)`` from the table block of a series-matrix file; one row per cell of it.

    The block lies between its begin and end lines; only the header line's
    sample names go through the driver.
    """
    lines = spark.read.text(path).select("value")
    body = lines.where(~F.col("value").startswith("!") & (F.length("value") > 0)).select(F.split(F.regexp_replace("value", '"', ""), "\t").alias("cells"))
    names = [r.cells for r in body.where(F.upper(F.col("cells")[0]) == "ID_REF").limit(1).collect()]
    if not names:
        raise ValueError("the file has no table block")
    samples = F.array(*[F.lit(n) for n in names[0]])
    rows = body.where(F.upper(F.col("cells")[0]) != "ID_REF").select(F.col("cells")[0].alias("feature"), F.posexplode("cells").alias("k", "text")).where("k > 0")
    return rows.select("feature", F.element_at(samples, F.col("k") + 1).alias("sample"), F.col("text").try_cast("double").alias("value"))


def matrix_market(spark: SparkSession, matrix: str, features: str, barcodes: str) -> DataFrame:
    """``(cell, gene, value)`` from a coordinate matrix with its feature and barcode lists.

    The lists get their line numbers from Spark's file order; they are short
    beside the matrix and joined by number.
    """

    def numbered(path: str, name: str) -> DataFrame:
        text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.regexp_replace("value", "\r", "")), "\n")).alias("k", "line"))
        return text.select((F.col("k") + 1).alias(f"{name}_no"), F.split("line", "\t").alias("p")).select(f"{name}_no", F.col("p")[F.when(F.size("p") > 1, 1).otherwise(0)].alias(name))

    entries = spark.read.text(matrix).where(~F.col("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 3)
    entries = entries.select(F.col("p")[0].cast("int").alias("gene_no"), F.col("p")[1].cast("int").alias("cell_no"), F.col("p")[2].cast("double").alias("value"))
    # The size line is the first that is no comment.
    first = spark.read.text(matrix).where(~F.col("value").startswith("%")).limit(1).collect()[0].value.split()
    cells, genes = numbered(barcodes, "cell"), numbered(features, "gene")
    is_size = (F.col("gene_no") == int(first[0])) & (F.col("cell_no") == int(first[1])) & (F.col("value") == float(first[2]))
    return entries.where(~is_size).join(F.broadcast(genes), "gene_no").join(F.broadcast(cells), "cell_no").select("cell", "gene", "value")


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of BibTeX files as key, kind and a map of fields; values in braces, nested or not, quotes or bare.

    An entry begins at an ``@`` at a line's start.  Of a field given twice the last counts.
    """
    entry = F.explode(F.split("value", r"(?m)^(?=\s*@\w)"))
    text = spark.read.text(path, wholetext=True).select(entry.alias("e")).where(F.col("e").rlike(r"^\s*@\w+\s*\{\s*[^,\s=]+\s*[,}]"))
    text = text.where(~F.lower("e").rlike(r"^\s*@(comment|string|preamble)\b"))
    key, kind = F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s}]+)", 1), F.lower(F.regexp_extract("e", r"@(\w+)", 1))
    return text.select(key.alias("key"), kind.alias("kind"), bibtex_fields(F.col("e")).alias("fields"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def bibtex_fields(entries: pd.Series) -> pd.Series:
    return pd.Series([_fields_of(e) for e in entries])


_FIELD = re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*")


def _fields_of(entry: str) -> dict[str, str]:
    """Names and values of one entry, read from left to right."""
    at = re.match(r"\s*@\w+\s*\{\s*[^,]*", entry).end()
    out: dict[str, str] = {}
    while named := _FIELD.match(entry, at):
        begin, depth, at = named.end(), 0, named.end()
        quoted = entry[begin : begin + 1] == '"'
        while at < len(entry):
            c = entry[at]
            if c == "\\":
                at += 1
            elif c == "{":
                depth += 1
            elif c == "}" and depth:
                depth -= 1
            elif quoted and c == '"' and not depth and at > begin:
                at += 1
                break
            elif not quoted and not depth and c in ",}":
                break
            at += 1
        value = entry[begin:at].strip()
        if value[:1] == "{" and value[-1:] == "}" or value[:1] == value[-1:] == '"' and len(value) > 1:
            value = value[1:-1]
        out[named[1].lower()] = " ".join(value.split())
    return out


def ris(spark: SparkSession, path: str) -> DataFrame:
    """Records of RIS files as an ordinal and a map from tag to its values."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.regexp_extract_all(F.regexp_replace("value", "\r", ""), F.lit(r"(?sm)^(TY  - .*?)^ER  -"), F.lit(1))).alias("record", "body"))
    lines = text.select("file", "record", F.posexplode(F.split("body", "\n")).alias("k", "line")).where(F.col("line").rlike(r"^[A-Z][A-Z0-9]  - "))
    tags = lines.groupBy("file", "record", F.substring("line", 1, 2).alias("tag")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("line", 7, 1 << 20).alias("v")))), lambda x: x["v"]).alias("values"))
    return tags.groupBy("file", "record").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("fields"))


def export(df: DataFrame, path: str, kind: str, single: bool = False) -> None:
    """Write as json, csv or parquet; ``single`` asks for one file."""
    writer = (df.coalesce(1) if single else df).write.mode("overwrite")
    {"json": writer.json, "csv": lambda p: writer.csv(p, header=True), "parquet": writer.parquet}[kind](path)


def markdown(df: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table, without its heading."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Both tables' rows, of each key the one of the highest version; on ties the change."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__p", place).where("__p = 1").drop("__p", "__new")
