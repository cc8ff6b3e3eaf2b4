"""Message queues: files of timed messages, batch statistics, retention, and streaming readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "queue_prefix string, file_id long, file_offset long, timestamp_ms long, message binary"


def file_stats(messages: DataFrame) -> DataFrame:
    """Per queue file its distinct messages, their offsets and the file's last time."""
    one = messages.groupBy("queue_prefix", "file_id", "file_offset").agg(F.max("timestamp_ms").alias("ts"))
    return one.groupBy("queue_prefix", "file_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("file_offset").alias("first_offset"), F.max("file_offset").alias("last_offset"), F.max("ts").alias("last_ms")
    )


def old_files(messages: DataFrame, threshold_ms: int, exclude_latest: bool = True) -> DataFrame:
    """Files whose last message is older than the threshold; whole files only, and never the latest
    of a queue unless asked."""
    files = messages.groupBy("queue_prefix", "file_id").agg(F.max("timestamp_ms").alias("last_ms"))
    latest = F.max("file_id").over(Window.partitionBy("queue_prefix"))
    keep = (F.col("file_id") < latest) if exclude_latest else F.lit(True)
    return files.withColumn("keep", keep).filter(F.col("keep") & (F.col("last_ms") < threshold_ms)).drop("keep")


def retain(messages: DataFrame, threshold_ms: int) -> DataFrame:
    """Messages that stay after retention."""
    gone = old_files(messages, threshold_ms).select(F.col("queue_prefix").alias("q"), F.col("file_id").alias("f"))
    return messages.join(gone, messages.queue_prefix.eqNullSafe(gone.q) & (messages.file_id == gone.f), "left_anti")


def since(messages: DataFrame, min_timestamp: int) -> DataFrame:
    return messages.filter(F.col("timestamp_ms") >= min_timestamp)


def monotone(messages: DataFrame) -> DataFrame:
    """Times forced not to decrease along each queue file, in the order of the offsets."""
    w = Window.partitionBy("queue_prefix", "file_id").orderBy("file_offset").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("timestamp_ms", F.max("timestamp_ms").over(w))


def tail(spark: SparkSession, path: str, schema: str = SCHEMA, min_timestamp: int | None = None, files_per_batch: int = 100) -> DataFrame:
    """Stream of the messages that arrive as Parquet files in a folder."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream if min_timestamp is None else since(stream, min_timestamp)


def poll(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; each batch goes to ``handle`` with its number. A batch that
    failed is handed out again under the same number, so an idempotent handler loses nothing."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """Process messages as they come, until the query is stopped."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def deduplicate(stream: DataFrame) -> DataFrame:
    """Drop repeated messages by name, however late or far apart they arrive; the first arrival of a
    name is never dropped. There is no watermark, so the state holds every name seen: for long streams
    let the session keep it on disk (``spark.sql.streaming.stateStore.providerClass``, RocksDB)."""
    return stream.dropDuplicates(["queue_prefix", "file_id", "file_offset"])
