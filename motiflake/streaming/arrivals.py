"""Streams: call files that arrive one after another, and windows over an event stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inherit as H


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, on a time with a zone; a batch as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum in windows of `width`; events later than `late` behind the latest are left out when streaming."""
    x = _marked(events, time, late)
    g = x.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """One row for each run of a key's events that no pause of `gap` breaks."""
    x = _marked(events, time, late)
    g = x.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def inherit_as_files_arrive(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str):
    """A query that adds each batch of trio rows (parquet files with c0..f1 and contig below path) to counts by contig."""

    def batch(df: DataFrame, number: int) -> None:
        k = H.with_kinds(df)
        k.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("strict").cast("int")).alias("n_strict")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
