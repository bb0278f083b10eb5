"""Event streams: windowed metrics with late data, and budgets that start anew when they run out.

The same functions take batch and streaming frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def parse_time(text):
    """Timestamps from ISO text, also where both an offset and a Z stand at the end."""
    return F.to_timestamp(F.regexp_replace(text, r"(\+00:00)Z$", "$1"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour", time: str = "ts", value: str = "value", by: str = "event_type") -> DataFrame:
    """Count, sum and mean per tumbling window and kind; events later than the watermark are dropped."""
    frame = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    out = frame.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "total", "mean")


def run_once(frame: DataFrame, folder: str, name: str) -> StreamingQuery:
    """Process what is there, append to Parquet under ``folder`` and stop."""
    query = frame.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def budget_periods(events: DataFrame, key: str, time: str, cost: str, days: float) -> DataFrame:
    """Spending by period, where a period starts at the first event after the last one ended.

    Periods depend on one another within a key, so keys are folded in order;
    costs are summed per key and minute before, which bounds a key's group by
    the span of time and not by its number of events.
    """
    minutes = events.groupBy(F.col(key).cast("string").alias("key"), F.date_trunc("minute", time).alias("at")).agg(F.sum(cost).alias("cost"), F.count("*").alias("n"))
    length = pd.Timedelta(days=days)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, start, total, n, out = None, None, 0.0, 0, []
        for part in parts:
            for k, at, c, m in part.itertuples(index=False):
                if k != key_now or at - start >= length:
                    if key_now is not None:
                        out.append((key_now, start, total, n))
                    key_now, start, total, n = k, at, 0.0, 0
                total, n = total + c, n + m
            if out:
                yield pd.DataFrame(out, columns=["key", "started", "spent", "n"])
                out = []
        if key_now is not None:
            yield pd.DataFrame([(key_now, start, total, n)], columns=["key", "started", "spent", "n"])

    return minutes.repartition("key").sortWithinPartitions("key", "at").select("key", "at", "cost", "n").mapInPandas(fold, "key string, started timestamp, spent double, n long")
