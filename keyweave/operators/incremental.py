"""Processing only new or changed records by diffing immutable table versions.

Messages arrive as immutable files in a folder. :func:`take_in` diffs the folder's manifest against the
one of its last run and adds the messages of the added files to a stored table of versions, from which
those of removed files are deleted; the folder's manifest is saved in the same commit.

A reader of a queue has processed a version of its own: the stored table less the deletion vector of
everything from its position on. :func:`reader_delta` diffs that version against the current one file
by file, on manifests alone: files wholly before the position are in both, files wholly behind it are
added, and the file that the position cuts is changed. :func:`unread_messages` reads the rows of these
files only. A consumer that commits its output through :func:`keyweave.sources.versioned.process_new`
saves the version it has processed with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.sources.versioned import VersionedTable, ingest

#: Stored messages: their names and times, and the file they came from. The content stays in the files.
MESSAGES = "queue string, file_id long, file_offset long, ts long, source string"


def run_succeeded(status: Column) -> Column:
    """``ok``, whatever its case and outer blanks; anything else, null too, is not a success."""
    return F.coalesce(F.lower(F.btrim(status, F.lit(" \t\r\n\x0b\x0c"))) == "ok", F.lit(False))


def reader_positions(runs: DataFrame) -> DataFrame:
    """Per reader the position after its last successful run (run_no, then attempt):
    ``reader_id, queue, min_ts, file_id, file_offset``; before everything (-1, -1) without one.

    A successful run with a null position does not move the reader. Repeated rows change nothing.
    """
    ok = run_succeeded(F.col("run_status")) & F.col("file_id_").isNotNull() & F.col("file_offset_").isNotNull()
    last = F.max(F.when(ok, F.struct("run_no", "attempt", F.col("file_id_").alias("f"), F.col("file_offset_").alias("o"))))
    return (
        runs.filter("reader_id IS NOT NULL")
        .groupBy("reader_id")
        .agg(F.max("queue_prefix").alias("queue"), F.max("min_timestamp").alias("min_ts"), last.alias("p"))
        .select(
            "reader_id",
            "queue",
            F.coalesce("min_ts", F.lit(-(2**63))).alias("min_ts"),
            F.coalesce("p.f", F.lit(-1)).cast("long").alias("file_id"),
            F.coalesce("p.o", F.lit(-1)).cast("long").alias("file_offset"),
        )
    )


def message_store(spark: SparkSession, path: str) -> VersionedTable:
    """The stored messages under ``path``; each commit is sorted, so that a file holds a range of a queue."""
    return VersionedTable(spark, path, MESSAGES, entry_by=["queue"], ordered_by=["file_id", "file_offset"], latest=["ts"])


def message_rows(messages: DataFrame) -> DataFrame:
    """The distinct messages of some source files, one row per message and file.

    The content is not read. Rows without a name (null queue, file or offset) are no messages; of
    repeated rows with different timestamps the latest counts.
    """
    named = messages.select(
        F.col("queue_prefix").alias("queue"),
        F.col("file_id").cast("long").alias("file_id"),
        F.col("file_offset").cast("long").alias("file_offset"),
        F.col("timestamp_ms").cast("long").alias("ts"),
        "source",
    ).filter("queue IS NOT NULL AND file_id IS NOT NULL AND file_offset IS NOT NULL")
    return named.groupBy("queue", "file_id", "file_offset", "source").agg(F.max("ts").alias("ts"))


def take_in(store: VersionedTable, folder: str) -> DataFrame | None:
    """One run over a folder of message files: only files that are new, rewritten or gone since the last
    run count. Returns the frame of the files it read, or None."""
    return ingest(store, folder, message_rows)


def reader_delta(positions: DataFrame, entries: DataFrame) -> DataFrame:
    """Diff of each reader's processed version against the current one: ``reader_id, queue, min_ts, file,
    change, from_file, from_offset``; the last two are the deletion vector of a ``changed`` file (what
    lies before them is processed). Files whose latest message is older than the reader's minimum are
    left out."""
    p, e = positions.alias("p"), entries.alias("e")
    at = F.struct(F.col("p.file_id").alias("file_id"), F.col("p.file_offset").alias("file_offset"))
    ahead = (F.col("e.hi") >= at) & (F.col("e.latest.ts") >= F.col("p.min_ts"))
    return p.join(e, (F.col("p.queue") == F.col("e.queue")) & ahead).select(
        "p.reader_id",
        F.col("p.queue").alias("queue"),
        "p.min_ts",
        "e.file",
        F.when(F.col("e.lo") < at, F.lit("changed")).otherwise(F.lit("added")).alias("change"),
        F.col("p.file_id").alias("from_file"),
        F.col("p.file_offset").alias("from_offset"),
    )


def unread_messages(store: VersionedTable, runs: DataFrame, version: int | None = None) -> DataFrame:
    """``reader_id, file_id, file_offset, ts``: what each reader has still to read, each message once.

    The join to the rows runs on data files, whose rows are bounded, so no queue is ever one task's work;
    every joined pair is a result but for the processed part of a cut file, old messages and repeats.
    Messages with a null timestamp are older than any minimum. Empty tables give no rows.
    """
    version = store.version() if version is None else version
    delta = reader_delta(reader_positions(runs), store.entries(version))
    rows = store.read(version, positions=True, files=delta).alias("r")
    d = delta.alias("d")
    same = (F.col("d.file") == F.col("r.__file")) & (F.col("d.queue") == F.col("r.queue")) & (F.col("r.ts") >= F.col("d.min_ts"))
    here = F.struct(F.col("r.file_id").alias("f"), F.col("r.file_offset").alias("o"))
    live = here >= F.struct(F.col("d.from_file").alias("f"), F.col("d.from_offset").alias("o"))
    found = rows.join(d, same & live).select("d.reader_id", "r.file_id", "r.file_offset", "r.ts")
    return found.groupBy("reader_id", "file_id", "file_offset").agg(F.max("ts").alias("ts"))
