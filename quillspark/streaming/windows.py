"""Structured Streaming forms of the time-based operators, and of changes and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggs: list[Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates per event-time window, tumbling or sliding; works on streams and on tables."""
    src = df.withWatermark(time, late) if df.isStreaming else df
    out = src.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str = "10 minutes") -> DataFrame:
    src = df.withWatermark(time, late) if df.isStreaming else df
    out = src.groupBy(F.session_window(time, gap), *keys).agg(*aggs)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def follow(spark: SparkSession, path: str, schema) -> DataFrame:
    """A change feed: rows of files as they appear in a table's folder."""
    return spark.readStream.schema(schema).parquet(path)


def maintain(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True):
    """Keep a view up to date batch by batch; with ``once`` it catches up and ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()


def result(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now: in complete mode the last version of the whole, else all rows."""
    spark, schema = stream.sparkSession, stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={0 if mode == 'complete' else number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/result")
