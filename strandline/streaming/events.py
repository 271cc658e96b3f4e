"""Streaming: windowed counts with late data, first-seen dedupe, incremental ingest of artefacts.

These go beyond what the batch engine's users had; a run with availableNow gives what the batch gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.artifacts import Parser, parse


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files below a folder, of the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type") -> DataFrame:
    """(window_start, key, n, total) per window; on a stream, rows later than the watermark are left out."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__t", late)
    out = rows.groupBy(F.window("__t", window), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): sessions that end after a gap without events."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__t", late)
    out = rows.groupBy(F.session_window("__t", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Rows whose keys have not been seen within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark(keys).drop("__t")


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into Parquet, then stop."""
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(target)
    query.awaitTermination()
    return query


def ingest_artifacts(spark: SparkSession, folder: str, parser: Parser, target: str, checkpoint: str) -> StreamingQuery:
    """Parse text artefacts that have arrived since the last run into entity rows."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*").load(folder)
    texts = files.select("path", F.decode("content", "UTF-8").alias("content"))
    return run_available(parse(texts, parser), target, checkpoint)
