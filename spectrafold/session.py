"""Session construction and table access shared by the query entry points."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spectrafold", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; ``conf`` overrides them."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one where none is set and Spark runs in this process, as in tests."""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the cluster's shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Batches for Python workers hold at most about ``most`` bytes, where a row is a chunk of a table; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, None)
    if said is None or not str(said).isdigit() or int(said) > most:
        spark.conf.set(key, str(most))
