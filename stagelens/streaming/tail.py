"""Event logs as they are written: lines in, canonical events out, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.eventlog import event_of, log_name_of


def tail(spark: SparkSession, folder: str, most_files: int = 200) -> DataFrame:
    """New log files of a folder as a stream of (log_name, event, ts, value)."""
    text = spark.readStream.format("text").option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", True).load(folder)
    value = F.col("value")
    places = ("$.Timestamp", "$.time", "$['Submission Time']", "$['Completion Time']", "$['Task Info']['Finish Time']", "$['Stage Info']['Submission Time']")
    ms = F.coalesce(*(F.get_json_object(value, p).cast("bigint") for p in places))
    return text.select(log_name_of(F.col("_metadata.file_path")).alias("log_name"), event_of(value).alias("event"), F.timestamp_millis(ms).alias("ts"), "value")


def event_counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by log, kind and time window; lines that come twice in the watermark's time count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["log_name", "value"])
    return once.groupBy(F.window("ts", window), "log_name", "event").agg(F.count("*").alias("n"))


def into_table(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a table by log and event; what is there already is processed, then it ends."""
    return events.writeStream.format("parquet").partitionBy("event").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
