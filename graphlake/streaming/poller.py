"""Streams: listings that arrive as files become deltas of the file state; events become windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import classify_files
from ..schema import FILE_HASH


def interval_s(files: int) -> int:
    """Seconds between two looks at a tree: 5 and 1 more for each 500 files, 60 at most."""
    return min(60, 5 + files // 500)


def watch_listings(spark: SparkSession, folder: str, checkpoint: str, state: Callable[[], DataFrame], on_change: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Each new listing under folder (Parquet files of FILE_HASH rows) is compared with the state and handed on.

    on_change gets rel_path and status of what is not unchanged, and the batch number; a batch that is run again
    after a failure has the same number.
    """
    listings = spark.readStream.schema(FILE_HASH).parquet(folder)

    def compare(batch: DataFrame, number: int) -> None:
        changes = classify_files(state(), batch).filter("status <> 'unchanged'")
        on_change(changes, number)

    writer = listings.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_s(0)} seconds")).start()


def windowed_counts(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total over event time; later rows than `late` are dropped once their window is closed."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
