"""Structured Streaming over event tables: an extension, as the embedded dialect has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and tumbling window; works on streams (with a watermark) and on tables alike."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_available(spark: SparkSession, source: str, schema, sink: str, checkpoint: str) -> None:
    """Read the Parquet files of a folder as a stream, aggregate, append finished windows as Parquet, and stop when all is read."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = windowed_counts(stream).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
