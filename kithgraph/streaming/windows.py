"""Streams of events: likes an item got within sliding windows, and the recency window as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """An event stream over Parquet files as they arrive."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 8).parquet(folder)


def counts(events: DataFrame, width: str = "14 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by item and sliding window; windows older than the watermark are final and leave the state."""
    item = F.get_json_object("props", "$.k").cast("long").alias("item_id")
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), item).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "item_id", "n")


def recommend_each(stream: DataFrame, sink, checkpoint: str):
    """Hands every micro-batch to `sink(batch, number)`; the offsets live in the shared checkpoint folder."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
