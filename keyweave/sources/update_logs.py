"""Update logs of tables: loggers to hand to a table, and replay and retention of logs in queue files."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.operators import changelog
from keyweave.operators.point import KEY, VALUE
from keyweave.sources import records
from keyweave.streaming import queues


def _bytes(x) -> bytes:
    return b"" if x is None else x.encode() if isinstance(x, str) else bytes(x) if isinstance(x, (bytes, bytearray)) else str(x).encode()


class LineLogger:
    """Keeps changes as lines (kind, key, value parted by tabs) to take from both ends; a test sink."""

    def __init__(self) -> None:
        self.lines: deque[str] = deque()

    def __call__(self, changes: DataFrame) -> None:
        for r in changes.toLocalIterator():
            parts = [r["op"]] + [_bytes(r[c]).decode(errors="replace") for c in (KEY, VALUE)][: {"SET": 2, "REMOVE": 1}.get(r["op"], 0)]
            self.lines.append("\t".join(parts))

    def pop_front(self) -> str | None:
        return self.lines.popleft() if self.lines else None

    def pop_back(self) -> str | None:
        return self.lines.pop() if self.lines else None


class TableLogger:
    """Applies every change to another table, which so mirrors the first."""

    def __init__(self, mirror) -> None:
        self._mirror = mirror

    def __call__(self, changes: DataFrame) -> None:
        one = changes.select(F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), "op", F.lit(0).alias("server_id"), F.lit(0).alias("dbm_index"), KEY, VALUE)
        self._mirror.apply_log(one)


class QueueLogger:
    """Writes every change as an entry of a queue; changes stream through the driver one by one."""

    def __init__(self, writer: records.QueueWriter, server_id: int = 0, dbm_index: int = 0, clock: Callable[[], float] = time.time) -> None:
        self._writer, self._origin, self._clock = writer, (server_id, dbm_index), clock

    def __call__(self, changes: DataFrame) -> None:
        for r in changes.toLocalIterator():
            entry = changelog.encode_entry(r["op"], *self._origin, _bytes(r[KEY]), _bytes(r[VALUE]))
            self._writer.write(int(self._clock() * 1000), entry)
        self._writer.flush()


def read_log(spark: SparkSession, path: str, min_timestamp: int = 0, decode: bool = True) -> DataFrame:
    """Entries of the queue files of a folder: ``queue_prefix, ts, seq, status, op, server_id, dbm_index,
    key, value``; ``seq`` is their order within a queue; ``key`` and ``value`` are binary, or text if
    they are to be decoded."""
    records.register(spark)
    df = spark.read.format("queuefiles").option("path", path).option("min_timestamp", str(min_timestamp)).option("ignore_broken", "true").load()
    e = df.select("queue_prefix", F.col("timestamp_ms").alias("ts"), (F.shiftleft("file_id", 40) + F.col("file_offset")).alias("seq"), changelog.parse_entries(F.col("message")).alias("e"))
    kind = "string" if decode else "binary"
    return e.select("queue_prefix", "ts", "seq", "e.status", "e.op", "e.server_id", "e.dbm_index", *[F.col(f"e.{c}").cast(kind).alias(c) for c in (KEY, VALUE)])


def apply_log_files(table, path: str, min_timestamp: int = 0, server_id: int = changelog.EVERYTHING, dbm_index: int = changelog.EVERYTHING) -> None:
    """Replay the entries of a folder's queue files on a table, those not older than the minimum and of the
    wanted origins, in their order; what is no entry is skipped."""
    kinds = {f.name: f.dataType for f in table.df().schema.fields}
    log = read_log(table.spark, path, min_timestamp).filter("status = 'SUCCESS'")
    typed = log.select("ts", "seq", "op", "server_id", "dbm_index", *[F.col(c).cast(kinds[c]).alias(c) for c in (KEY, VALUE)])
    table.apply_log(typed, server_id, dbm_index, min_timestamp)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``queue_prefix, file_id, n_messages, first_offset, last_offset, last_ms`` of a folder's queue files."""
    records.register(spark)
    return queues.file_stats(spark.read.format("queuefiles").option("path", path).option("ignore_broken", "true").load())


def remove_old_files(spark: SparkSession, path: str, threshold_ms: int, exclude_latest: bool = True) -> list[str]:
    """Delete the queue files of a folder whose last message is older than the threshold, but never a
    queue's latest file unless asked. Returns the files deleted."""
    records.register(spark)
    old = queues.old_files(spark.read.format("queuefiles").option("path", path).option("ignore_broken", "true").load(), threshold_ms, exclude_latest)
    system, folder = records.file_system(path)
    gone = [f"{folder}/{r.queue_prefix}.{r.file_id:010d}" for r in old.orderBy("queue_prefix", "file_id").toLocalIterator()]
    for f in gone:
        system.delete_file(f)
    return gone
