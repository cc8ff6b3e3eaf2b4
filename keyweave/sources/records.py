"""Record files: flat records, TSV, key lines and text lines; and queue files.

Flat-record and queue files are Spark data sources (``register(spark)`` names them ``flatrecords`` and
``queuefiles``): a file is a partition, read as a stream with bounded buffers, so folders of any size
are read in parallel. The text formats are Spark's own text source with expressions.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from keyweave.functions import strings
from keyweave.functions.codecs import put_varint
from keyweave.functions.hashes import CHECKSUM_MODULUS
from keyweave.model import Status, StatusError
from keyweave.operators.point import KEY, VALUE

# First bytes of flat records and of queue records, and sizes of a queue file's parts.
FLAT_DATA, FLAT_METADATA = 0xFF, 0xFE
QUEUE_DATA, QUEUE_HEADER, QUEUE_METADATA_SIZE = 0xFF, 11, 32


# Flat records


def write_flat(out: BinaryIO, data: bytes, metadata: bool = False) -> None:
    out.write(bytes([FLAT_METADATA if metadata else FLAT_DATA]) + put_varint(len(data)) + data)


def read_flat(src: BinaryIO) -> Iterator[tuple[bool, bytes]]:
    """(is metadata, data) of each record; anything malformed or cut off is broken data."""
    while head := src.read(1):
        if head[0] not in (FLAT_DATA, FLAT_METADATA):
            raise StatusError(Status.BROKEN_DATA, "not a flat record")
        n = 0
        while True:
            c = src.read(1)
            if not c:
                raise StatusError(Status.BROKEN_DATA, "cut off")
            n = n << 7 | c[0] & 0x7F
            if c[0] < 0x80:
                break
        data = src.read(n)
        if len(data) < n:
            raise StatusError(Status.BROKEN_DATA, "cut off")
        yield head[0] == FLAT_METADATA, data


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI: local disks, HDFS and object stores alike."""
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(path: str, suffix: str = "") -> list[str]:
    """Files of a folder (or the file itself) in the order of their names; hidden ones are left out."""
    system, p = file_system(path)
    if system.get_file_info(p).type == fs.FileType.File:
        return [p]
    found = [f.path for f in system.get_file_info(fs.FileSelector(p, allow_not_found=True)) if f.type == fs.FileType.File]
    return sorted(f for f in found if not f.rpartition("/")[2].startswith(("_", ".")) and f.endswith(suffix))


class _File(InputPartition):
    pass


class FlatRecordSource(DataSource):
    """Options: ``path`` (a file or folder on shared storage), ``keys_only``. Columns key, value."""

    @classmethod
    def name(cls) -> str:
        return "flatrecords"

    def schema(self) -> str:
        return "key binary" if self.options.get("keys_only", "") == "true" else "key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _FlatReader(self.options["path"], len(schema) == 1)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FlatWriter(self.options["path"], overwrite)


class _FlatReader(DataSourceReader):
    def __init__(self, path: str, keys_only: bool) -> None:
        self._path, self._keys_only = path, keys_only

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in list_files(self._path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with file_system(self._path)[0].open_input_stream(partition.value, buffer_size=1 << 20) as f:
            data = (d for meta, d in read_flat(f) if not meta)
            if self._keys_only:
                yield from ((d,) for d in data)
                return
            for key in data:
                value = next(data, None)
                if value is None:
                    raise StatusError(Status.BROKEN_DATA, "odd number of records")
                yield key, value


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class _FlatWriter(DataSourceWriter):
    """A file per task under a hidden name; the commit renames them, so failed tasks leave nothing."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self._path, self._overwrite = path, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, folder = file_system(self._path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/.part-{uuid.uuid4().hex}.flat"
        with system.open_output_stream(name, buffer_size=1 << 20) as f:
            for row in rows:
                for data in row:
                    data = b"" if data is None else data.encode() if isinstance(data, str) else bytes(data)
                    write_flat(f, data)
        return _Written(name)

    def commit(self, messages: list) -> None:
        system = file_system(self._path)[0]
        old = list_files(self._path, ".flat") if self._overwrite else []
        for i, m in enumerate(x for x in messages if x is not None):
            head, _, tail = m.path.rpartition("/")
            system.move(m.path, f"{head}/part-{i:05d}-{tail[6:]}")
        for f in old:
            system.delete_file(f)

    def abort(self, messages: list) -> None:
        for m in messages:
            system = file_system(self._path)[0]
            if m is not None and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


# Queue files


def _checksum(*parts: bytes) -> int:
    return sum(map(sum, parts)) % CHECKSUM_MODULUS[8] + 1


def queue_record(timestamp_ms: int, message: bytes) -> bytes:
    head = bytes([QUEUE_DATA]) + timestamp_ms.to_bytes(6, "big") + struct.pack(">I", len(message))
    return head + message + bytes([_checksum(head, message)])


def read_queue(src: BinaryIO, min_timestamp: int = 0, offset: int = 0, ignore_broken: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(offset, time, message) of the records from an offset on; a zeroed or cut-off tail is the end."""
    at = max(offset, QUEUE_METADATA_SIZE)
    src.seek(at)
    while len(head := src.read(QUEUE_HEADER)) == QUEUE_HEADER:
        if head[0] != QUEUE_DATA:
            if not any(head):
                return
            raise StatusError(Status.BROKEN_DATA, f"not a record at {at}")
        ts, n = int.from_bytes(head[1:7], "big"), struct.unpack(">I", head[7:])[0]
        body = src.read(n + 1)
        if len(body) < n + 1:
            return
        if body[n] != _checksum(head, body[:n]):
            if not ignore_broken:
                raise StatusError(Status.BROKEN_DATA, f"checksum at {at}")
        elif ts >= min_timestamp:
            yield at, ts, body[:n]
        at += QUEUE_HEADER + n + 1


def queue_paths(prefix: str) -> list[str]:
    """The numbered files of a queue, in order."""
    folder, _, name = prefix.rpartition("/")
    return [f for f in list_files(folder or ".") if re.fullmatch(re.escape(name) + r"\.\d{10}", f.rpartition("/")[2])]


class QueueWriter:
    """Appends messages to the numbered files ``prefix.0000000000`` of a queue, for producers of modest
    rate (bulk data is Parquet).

    A queue that exists is taken up where it ends: its last file is read once, a cut-off record at its
    end is dropped with a new file. Times never decrease, over files and writers: a message that claims
    an earlier time than the last one gets that one's. A new file starts when the size is reached.
    """

    def __init__(self, prefix: str, max_file_size: int = 1 << 30) -> None:
        self._system, self._prefix = file_system(prefix)
        self._max, self._out, self._size = max_file_size, None, 0
        held = queue_paths(prefix)
        self._file = int(held[-1][-10:]) if held else -1
        self.last = self._read_time()
        if held:
            end = QUEUE_METADATA_SIZE
            with self._system.open_input_file(held[-1]) as f:
                for at, ts, message in read_queue(f, ignore_broken=True):
                    self.last, end = max(self.last, ts), at + QUEUE_HEADER + len(message) + 1
                if f.size() == end and end < max_file_size:
                    self._out, self._size = self._system.open_append_stream(held[-1]), end

    def _time_file(self) -> str:
        return f"{self._prefix}.time"

    def _read_time(self) -> int:
        if self._system.get_file_info(self._time_file()).type != fs.FileType.File:
            return 0
        with self._system.open_input_stream(self._time_file()) as f:
            return int(f.read() or 0)

    def write(self, timestamp_ms: int, message: bytes) -> int:
        """Returns the time the message got."""
        if self._out is None or self._size >= self._max:
            if self._out is not None:
                self._out.close()
            self._file += 1
            self._out, self._size = self._system.open_output_stream(f"{self._prefix}.{self._file:010d}"), QUEUE_METADATA_SIZE
            self._out.write(b"\0" * QUEUE_METADATA_SIZE)
        self.last = max(self.last, timestamp_ms)
        record = queue_record(self.last, message)
        self._out.write(record)
        self._size += len(record)
        return self.last

    def update_timestamp(self, timestamp_ms: int) -> None:
        """Advance the queue's time without a message, for readers and writers to come."""
        self.last = max(self.last, timestamp_ms)
        with self._system.open_output_stream(self._time_file()) as f:
            f.write(str(self.last).encode())

    def flush(self) -> None:
        if self._out is not None:
            self._out.flush()

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
        self._out = None

    def __enter__(self) -> QueueWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def write_queue(prefix: str, messages: list[tuple[int, bytes]], max_file_size: int = 1 << 30) -> list[str]:
    """Append messages to a queue; returns its files."""
    with QueueWriter(prefix, max_file_size) as w:
        for ts, message in messages:
            w.write(ts, message)
    return queue_paths(prefix)


class QueueFileSource(DataSource):
    """Options: ``path`` (folder), ``min_timestamp``, ``ignore_broken``. A file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "queuefiles"

    def schema(self) -> str:
        return "queue_prefix string, file_id long, file_offset long, timestamp_ms long, message binary"

    def reader(self, schema) -> DataSourceReader:
        return _QueueReader(dict(self.options))


class _QueueReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._path = options["path"]
        self._min = int(options.get("min_timestamp", 0))
        self._ignore = options.get("ignore_broken", "") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in list_files(self._path) if re.search(r"\.\d{10}$", f)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        prefix, _, number = partition.value.rpartition("/")[2].rpartition(".")
        with file_system(self._path)[0].open_input_file(partition.value) as f:
            for at, ts, message in read_queue(f, self._min, 0, self._ignore):
                yield prefix, int(number), at, ts, message


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlatRecordSource)
    spark.dataSource.register(QueueFileSource)


def export_flat(df: DataFrame, path: str, keys_only: bool = False) -> None:
    register(df.sparkSession)
    cols = [F.col(c).cast("binary").alias(c) for c in ([KEY] if keys_only else [KEY, VALUE])]
    df.select(*cols).write.format("flatrecords").option("path", path).mode("overwrite").save()


def import_flat(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("flatrecords").option("path", path).load()


# Text formats


def tsv_lines(df: DataFrame, escape: bool = False) -> DataFrame:
    """``value``: key, tab, value; control characters become blanks, or C escapes on request."""
    k, v = F.col(KEY).cast("string"), F.coalesce(F.col(VALUE).cast("string"), F.lit(""))
    k, v = (strings.escape_c(k), strings.escape_c(v)) if escape else (strings.trim_for_tsv(k), strings.trim_for_tsv(v, True))
    return df.select(F.concat(k, F.lit("\t"), v).alias("value"))


def export_tsv(df: DataFrame, path: str, escape: bool = False) -> None:
    tsv_lines(df, escape).write.mode("overwrite").text(path)


def parse_tsv(lines: DataFrame, unescape: bool = False) -> DataFrame:
    """Records of lines (``value``), split at the first tab; lines without one are skipped."""
    line, at = F.col("value"), F.instr("value", "\t")
    k, v = F.substring(line, F.lit(1), at - 1), F.substring(line, at + 1, F.length(line))
    return lines.filter(at > 0).select((strings.unescape_c(k) if unescape else k).alias(KEY), (strings.unescape_c(v) if unescape else v).alias(VALUE))


def _at() -> Column:
    """Where a line stands: its file, the split of the file, and its place in the split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"))


def import_tsv(spark: SparkSession, path: str, unescape: bool = False) -> DataFrame:
    """One record per key, that of the last line (by file, then place in the file)."""
    lines = spark.read.text(path).select("value", _at().alias("at")).filter(F.instr("value", "\t") > 0)
    line, tab = F.col("value"), F.instr("value", "\t")
    k, v = F.substring(line, F.lit(1), tab - 1), F.substring(line, tab + 1, F.length(line))
    k, v = (strings.unescape_c(k), strings.unescape_c(v)) if unescape else (k, v)
    return lines.select(k.alias(KEY), v.alias("v"), "at").groupBy(KEY).agg(F.max_by("v", "at").alias(VALUE))


def export_key_lines(df: DataFrame, path: str) -> None:
    df.select(F.col(KEY).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, line_no``: lines are numbered from 0 through all files, in the order of the files' names.

    Splits count their lines and a prefix sum over the splits gives each its first number, so no line is
    moved; ``line_no`` is exact whatever tasks read the splits."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), _at().alias("at")).select("line", "at.*")
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = splits.select("file", "split", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["file", "split"]).select("line", (F.col("start") + F.col("i") - F.col("lo")).alias("line_no"))
