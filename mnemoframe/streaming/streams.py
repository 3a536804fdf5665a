"""Structured Streaming versions of the event-time operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemoframe.functions.fixed import ABANDON_SECONDS


def events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """The event table as a stream of Parquet files, with the schema of the files that are there."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def idle_sessions(stream: DataFrame, lateness: str = "10 minutes", gap_seconds: int = ABANDON_SECONDS) -> DataFrame:
    """Sessions that end after the idle time: user, begin, end, events, value.  Events later than ``lateness`` are dropped."""
    marked = stream.withWatermark("ts", lateness)
    sessions = marked.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
    return sessions.select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("idle_at"), "n_events", "value")


def windowed_counts(stream: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Events per type in tumbling (or sliding) windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def usage(stream: DataFrame) -> DataFrame:
    """Running usage per user and event type (update mode)."""
    return stream.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sync(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every micro-batch to ``sink`` once; the checkpoint remembers how far the stream was read."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Read everything that is there, into an in-memory table (tests and small results)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
