"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an id table that may be broadcast (some 30 MB).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a fresh local one if Spark runs in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


#: Bytes of an Arrow batch handed to Python, so that long texts don't pile up there.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers hold at most about ``BATCH_BYTES``, whatever the rows; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, None)
    if said is None or not str(said).isdigit() or int(said) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder during one operator call.

    ``put`` cuts lineage with a replicated/shared parquet table, so a lost
    executor costs a reread and never a recomputation of the whole operator.
    ``drop`` removes tables no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        bounded_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, arrow_rows: int | None = None, options: dict | None = None) -> DataFrame:
        """``arrow_rows`` bounds the rows of a batch handed to Python, where rows are large; ``options`` are the writer's."""
        where, key = self.path(name), "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        if arrow_rows:
            self.spark.conf.set(key, arrow_rows)
        try:
            df.write.mode("overwrite").options(**(options or {})).parquet(where)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def release(self) -> None:
        """Have Spark remove the shuffle files of steps whose results are written: it does so once the driver has collected its garbage, Python's references first."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids`` (a written table of distinct ids).

    The ids are counted: few enough are broadcast, so that the documents are
    not shuffled; beyond that it is an ordinary shuffled semi-join.
    """
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_semi")
