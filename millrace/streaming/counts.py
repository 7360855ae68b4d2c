"""Extension: the same folds over unbounded inputs, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.mappers import tokens


def text_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Lines of text files as they arrive in ``folder``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def word_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Running word counts; write with output mode ``update`` or ``complete``."""
    return tokens(lines, column).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def event_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window; rows later than ``lateness`` no longer count, so state stays bounded."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counted = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
