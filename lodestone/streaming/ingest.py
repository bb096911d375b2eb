"""Incremental ingest over files: late data, duplicates and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, name: str = "events.parquet") -> DataFrame:
    """A stream over the files of a folder whose name fits, with the schema of those that are there."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path)


def once(stream: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows without repeats of a key inside the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums of values by window and event type."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there and stop; the next call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
