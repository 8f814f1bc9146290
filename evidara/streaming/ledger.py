"""The usage ledger as a stream: windowed counts with a watermark, and first-wins idempotency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def usage_by_window(events: DataFrame, *, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count and sum of value by event type and window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_requests(events: DataFrame, *, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, sink: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint lets the next call go on from it."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
