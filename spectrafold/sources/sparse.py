"""Sparse matrices on disk, of which slices are read without the rest.

A matrix is a folder of Parquet: ``cells`` in partitions of row blocks and column
blocks, ``rows`` and ``columns`` with the names in order.  A slice turns into
filters on the partitions, so Spark lists and opens only the blocks asked for, and
into filters on positions, which the files' own statistics narrow further, as
cells are sorted by the blocks asked for.  Blocks that would be too many folders
are joined to larger ones.  Cells that are not stored are zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.operators.statistics import numbered

ROWS, COLUMNS = 1 << 16, 1 << 10
#: Positions that are put into a filter one by one; more of them are joined.
LISTED = 1000
#: Blocks have folders of their own up to this many, or up to one for as many cells as the second number says.
FOLDERS, FOLDER_CELLS = 1024, 1 << 22


def write_matrix(cells: DataFrame, folder: str, block_rows: int = ROWS, block_columns: int = COLUMNS) -> None:
    """Store ``cells(row, column, value)`` by name; repeated cells are summed, zeros and cells without name dropped.

    Names get their positions in order.  Blocks of a matrix that is empty in them
    don't exist; where there are too many (``FOLDERS``), blocks are doubled in
    the direction that has more of them until there are few enough.
    """
    spark = cells.sparkSession
    cells = cells.where("row IS NOT NULL AND column IS NOT NULL")
    names, sizes, asked = {}, {}, {"row": block_rows, "column": block_columns}
    for side in asked:
        named = numbered(cells.select(F.col(side).alias("name")).distinct(), ["name"], "at").select("name", (F.col("at") - 1).alias("at"))
        named.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{folder}/{side}s")
        names[side] = spark.read.parquet(f"{folder}/{side}s")
        sizes[side] = footer_rows(spark, f"{folder}/{side}s")
    block, many = dict(asked), lambda side: -(-sizes[side] // block[side])
    if many("row") * many("column") > FOLDERS:
        most = max(FOLDERS, cells.count() // FOLDER_CELLS)
        while many("row") * many("column") > most:
            block[max(block, key=many)] *= 2
    placed = cells.groupBy("row", "column").agg(F.sum("value").cast("double").alias("value")).where("value <> 0")
    for side, named in names.items():
        placed = placed.join(named.select(F.col("name").alias(side), F.col("at").alias(f"{side}_at")), side)
    blocks = [F.floor(F.col(f"{side}_at") / b).cast("int").alias(f"{side}_block") for side, b in block.items()]
    within = [F.floor(F.col(f"{side}_at") / b) for side, b in asked.items()]
    placed = placed.select(*blocks, "row_at", "column_at", "value").repartition("row_block", "column_block")
    placed = placed.sortWithinPartitions("row_block", "column_block", *within, "row_at", "column_at")
    placed.write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("row_block", "column_block").parquet(f"{folder}/cells")
    spark.createDataFrame([(block["row"], block["column"])], "block_rows int, block_columns int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")


def shape(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Rows and columns, from the footers of the name files."""
    return footer_rows(spark, f"{folder}/rows"), footer_rows(spark, f"{folder}/columns")


def footer_rows(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files; no column is read, so only footers are."""
    return spark.read.parquet(path).select().count()


def _positions(names: DataFrame, wanted: Sequence | DataFrame) -> DataFrame:
    if isinstance(wanted, DataFrame):
        return names.join(wanted.select(F.col(wanted.columns[0]).alias("name")).distinct(), "name", "left_semi")
    return names.where(F.col("name").isin(list(wanted)))


def read_slice(spark: SparkSession, folder: str, rows: Sequence | DataFrame | range | None = None, columns: Sequence | DataFrame | range | None = None) -> DataFrame:
    """``(row, column, value)`` of the rows and columns named, in a list or a frame of one column, or in a range of positions."""
    layout = spark.read.parquet(f"{folder}/layout").first()
    # With its schema said, no other block's footer is read for it.
    cells = spark.read.schema("row_at int, column_at int, value double, row_block int, column_block int").parquet(f"{folder}/cells")
    for side, wanted, block in (("row", rows, layout.block_rows), ("column", columns, layout.block_columns)):
        names = spark.read.parquet(f"{folder}/{side}s")
        at, blocks = f"{side}_at", f"{side}_block"
        if isinstance(wanted, range):
            if wanted.step != 1:
                raise ValueError("a range of positions has no gaps")
            cells = cells.where(F.col(blocks).between(wanted.start // block, max(wanted.start, wanted.stop - 1) // block) & (F.col(at) >= wanted.start) & (F.col(at) < wanted.stop))
        elif wanted is not None:
            names = _positions(names, wanted)
            few = [r.at for r in names.select("at").limit(LISTED + 1).collect()]
            if len(few) <= LISTED:
                cells = cells.where(F.col(blocks).isin(sorted({a // block for a in few})) & F.col(at).isin(few))
            else:
                cells = cells.join(names.select(F.col("at").alias(at)), at, "left_semi")
        cells = cells.join(names.select(F.col("name").alias(side), F.col("at").alias(at)), at)
    return cells.select("row", "column", "value")


def sampled_variance(spark: SparkSession, folder: str, rows: int, columns: Sequence | DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``(column, mean, variance)`` over about ``rows`` rows chosen by hash, all if there are no more; population variance, zeros included."""
    names = spark.read.parquet(f"{folder}/rows")
    total = footer_rows(spark, f"{folder}/rows")
    chosen = names if total <= rows else names.where(F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    chosen = chosen.select("name")
    n = chosen.count()
    wanted = spark.read.parquet(f"{folder}/columns") if columns is None else _positions(spark.read.parquet(f"{folder}/columns"), columns)
    cells = read_slice(spark, folder, None if total <= rows else chosen, columns)
    m, a, v = F.coalesce("m", F.lit(0)), F.coalesce("a", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    told = wanted.select(F.col("name").alias("column")).join(cells.groupBy("column").agg(F.count("*").alias("m"), F.avg("value").alias("a"), F.var_pop("value").alias("v")), "column", "left")
    return told.select("column", (a * m / n).alias("mean"), (v * m / n + a * a * m * (n - m) / n / n).alias("variance"))
