"""Incremental ingestion: new files flow into a cache table once each.

Every micro-batch is a folder of its own under the sink, written over if the
batch is run again, so a retry changes nothing. The table is the latest row of
each key over all folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafwright.sources.cache_table import CacheTable


def ingest(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], sink: str, state: str, files_a_batch: int = 64) -> None:
    """Run what is new at ``source`` through ``transform`` (to rows with cache_key and text) into ``sink``; ``state`` keeps the progress."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).select("cache_key", "text").where("text <> ''").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def ingest_into(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], table: CacheTable, state: str, files_a_batch: int = 64) -> None:
    """``ingest`` into a versioned cache table: each micro-batch is one version, put once however often it is run."""

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(transform(batch), tag=(source, number))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def cached(spark: SparkSession, sink: str) -> DataFrame:
    """(cache_key, text): the last batch's text of each key, the greatest if that batch has several."""
    rows = spark.read.schema("cache_key string, text string, batch long").parquet(sink)
    return rows.groupBy("cache_key").agg(F.max_by("text", F.struct("batch", "text")).alias("text"))


def event_windows(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and kind; an extension, on batches and streams alike (late rows are dropped on streams)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): sessions with gaps below ``gap``; an extension."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
