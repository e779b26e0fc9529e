"""Event-time windows, for batch tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str, schema, late: str = "1 hour") -> DataFrame:
    """New files of a folder as a stream with a watermark on ts."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Count and sum of value in windows of a width (sliding, with ``slide``)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Each key's sessions: runs of events less than the gap apart."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("session_start"), "n", "total")


def distinct_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """First of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process what there is and stop, appending to Parquet; progress is in the checkpoint."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
