"""Incremental index of notes: a file stream whose batches are merged into the cache, newest version of each note first.

This is the streaming form of the scan of modified files; a batch is at most once in the index however often it is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_files(spark: SparkSession, root: str, pattern: str = "*.md", files_per_batch: int = 10_000) -> DataFrame:
    """New and changed files as a stream of (path, mod_time, content)."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    files = reader.load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mod_time"), F.col("value").alias("content"))


def newest(rows: DataFrame, key: str = "path", moment: str = "mod_time") -> DataFrame:
    """Newest version of each note."""
    columns = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(columns, F.col(moment)).alias("r")).select("r.*")


def keep_index(stream: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to the index table with its batch number; a batch that is repeated after a failure replaces itself. Readers take
    :func:`newest` of the table."""

    def merge(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, moment: str, window: str, late: str, *keys: str) -> DataFrame:
    """Events by time window and keys; events later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(moment, late).groupBy(F.window(moment, window), *keys).agg(F.count(F.lit(1)).alias("events"))
