"""Streams of feedback and event records: windowed counts with a watermark, appended as they close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum of ``value`` by window and key; works on streams and on tables."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def follow(spark: SparkSession, folder: str, like: DataFrame, out: str, checkpoint: str, time: str, key: str) -> StreamingQuery:
    """Append the closed windows of a folder of Parquet files to ``out``; stops when what is there has been read."""
    stream = windowed(spark.readStream.schema(like.schema).parquet(folder), time, key)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
