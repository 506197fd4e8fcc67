"""Streams of raw messages and readings.

`arrival_seq` must grow with delivery for each motor: the offset, where messages are keyed by
motor, or a number given when a message lands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import folders


def landing(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
            files_per_batch: int | None = None) -> DataFrame:
    """The files of a table as a stream, whether it is a folder of files or one file.

    A path without any file is an error: a stream on it would wait for ever without a word.
    """
    if not spark.read.format(fmt).schema(schema).load(path).inputFiles():
        raise FileNotFoundError(f"no {fmt} files in {path}")
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if folders.is_file(spark, path):  # a stream takes a file only as a pattern, this one matches nothing else
        folder, _, name = path.rpartition("/")
        path = f"{folder}/{{{name}}}"
    return reader.load(path)


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records, keyed by bus topic, as raw telemetry."""
    return records.select(
        F.col("key").cast("string").alias("topic"),
        F.col("value").cast("string").alias("payload"),
        F.col("offset").alias("arrival_seq"),
        F.col("timestamp").alias("arrival_ts"),
    )


def streaming_time(readings: DataFrame) -> DataFrame:
    """Event times as TIMESTAMP, which watermarks require."""
    return readings.withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def drop_redelivered(readings: DataFrame, delay: str) -> DataFrame:
    """Optional: drop redelivered readings that come within `delay` of the first."""
    return (
        streaming_time(readings)
        .withWatermark("event_ts", delay)
        .dropDuplicatesWithinWatermark(["motor_id", "event_ts"])
    )
