"""Tables as sequences of immutable versions, and processing of their changes exactly once.

A version is a manifest: the data files of the table and, per file, the row numbers deleted from it
(deletion vectors, kept as (file, row, version) rows). A commit writes only what it adds: data files,
the manifest of these files, the names of files it replaces, its deletion vectors; parts of earlier
commits are referred to, and merged when there are many. Then one small file is renamed to the
version's name, which fails if that exists; nothing before the rename is visible, so a failed run
leaves only unreferenced files. :meth:`VersionedTable.changes` diffs two manifests and reads only the
files and vectors in which they differ. :func:`process_new` stores the processed version of the source
in the commit of its output, :func:`ingest` the manifest of a folder of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.model import Status, StatusError
from keyweave.session import hadoop_path

_MANIFEST = "file string, n_rows long, n_files long"
_VECTORS = "file string, row long, version long"
_SOURCES = "path string, length long, changed timestamp"
#: Rows of a data file at most, and parts of a manifest after which a commit merges them.
FILE_ROWS, MERGE_PARTS = 1_000_000, 40


class VersionedTable:
    """A table under ``path`` on shared storage; ``schema`` is a StructType or DDL string.

    With ``ordered_by``, the rows of each commit are range-partitioned and sorted by ``entry_by`` and
    these columns, and :meth:`entries` tells per file and values of ``entry_by`` the least and greatest
    of them and the greatest values of the ``latest`` columns.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType | str, *, entry_by: Sequence[str] = (), ordered_by: Sequence[str] = (), latest: Sequence[str] = ()
    ) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self._by, self._ordered, self._latest = list(entry_by), list(ordered_by), list(latest)

    # Manifests

    def _version_file(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def version(self) -> int:
        """The latest version; 0 is the empty table."""
        fs, p = hadoop_path(self.spark, f"{self.path}/_versions")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName().removesuffix(".json") for s in fs.listStatus(p)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _entry(self, version: int) -> dict:
        if version == 0:
            return {"files": [], "gone": [], "entries": [], "vectors": [], "properties": {}}
        fs, p = hadoop_path(self.spark, self._version_file(version))
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def properties(self, version: int | None = None) -> dict[str, str]:
        return self._entry(self.version() if version is None else version)["properties"]

    def _parts(self, names: list[str], schema: T.StructType | str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/_manifests/{n}" for n in names])

    def _kept(self, frame: DataFrame, entry: dict) -> DataFrame:
        return frame.join(self._parts(entry["gone"], "file string"), "file", "left_anti") if entry["gone"] else frame

    def manifest(self, version: int | None = None) -> DataFrame:
        """``file, n_rows, n_files`` of a version; ``n_files`` counts the files of the file's commit, empty
        ones too."""
        entry = self._entry(self.version() if version is None else version)
        return self._kept(self._parts(entry["files"], _MANIFEST), entry)

    def _entry_schema(self) -> T.StructType:
        pick = lambda names: T.StructType([self.schema[n] for n in names])
        return T.StructType(
            [T.StructField("file", T.StringType()), *[self.schema[n] for n in self._by], T.StructField("n_rows", T.LongType()), T.StructField("lo", pick(self._ordered)), T.StructField("hi", pick(self._ordered))]
            + ([T.StructField("latest", pick(self._latest))] if self._latest else [])
        )

    def entries(self, version: int | None = None) -> DataFrame:
        """``file, entry_by..., n_rows, lo, hi, latest`` of a version (structs of the columns they are named after)."""
        entry = self._entry(self.version() if version is None else version)
        return self._kept(self._parts(entry["entries"], self._entry_schema()), entry)

    def vectors(self, version: int | None = None) -> DataFrame:
        """``file, row, version``: rows deleted up to a version, with the version that did."""
        return self._parts(self._entry(self.version() if version is None else version)["vectors"], _VECTORS)

    # Reading

    def _rows(self, files: DataFrame, positions: bool = False) -> DataFrame:
        """Rows of some files of the table (with ``n_files``), and ``__file`` and ``__row`` on request.

        A commit whose files are all wanted is read as one folder; names come to the driver only of
        commits that are wanted in part."""
        folder = F.split_part("file", F.lit("/"), F.lit(1))
        some = F.count(F.lit(1)) < F.max("n_files")
        wanted = files.groupBy(folder.alias("folder")).agg(F.when(some, F.collect_list("file")).alias("names")).collect()
        names = [n for r in wanted for n in (r.names or [r.folder])]
        extra = [F.lit(None).cast("string").alias("__file"), F.lit(None).cast("long").alias("__row")]
        if not names:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.select("*", *extra) if positions else empty
        df = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names])
        return df.select("*", self._place().alias("__file"), F.col("_metadata.row_index").alias("__row")) if positions else df

    @staticmethod
    def _place() -> Column:
        return F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+/[^/]+)$", 1)

    def _live(self, files: DataFrame, vectors: DataFrame) -> DataFrame:
        rows = self._rows(files, True)
        dead = vectors.select(F.col("file").alias("__file"), F.col("row").alias("__row"))
        return rows.join(dead, ["__file", "__row"], "left_anti")

    def read(self, version: int | None = None, positions: bool = False, files: DataFrame | None = None) -> DataFrame:
        """Rows of a version, or of those of its files that ``files`` names (``file``)."""
        version = self.version() if version is None else version
        listed = self.manifest(version)
        if files is not None:
            listed = listed.join(files.select("file").distinct(), "file", "left_semi")
        cols = [F.col(f"`{f.name}`") for f in self.schema.fields]
        if not positions and not self._entry(version)["vectors"]:
            return self._rows(listed).select(*cols)
        live = self._live(listed, self.vectors(version))
        return live.select(*cols, "__file", "__row") if positions else live.select(*cols)

    # Writing

    def _write(self, added: DataFrame, folder: str) -> None:
        """Write the data files of a commit."""
        cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows = added.select(*cols)
        if self._ordered:
            by = [F.col(f"`{c}`") for c in (*self._by, *self._ordered)]
            rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/data/{folder}")

    def _described(self, folder: str) -> DataFrame:
        """Entries of the files of a commit with their rows, from one scan of the columns they tell of;
        one entry a file if nothing is ordered."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}")
        aggs = [F.count(F.lit(1)).alias("n_rows")]
        if self._ordered:
            at = F.struct(*self._ordered)
            aggs += [F.min(at).alias("lo"), F.max(at).alias("hi")]
        if self._latest:
            aggs.append(F.struct(*[F.max(c).alias(c) for c in self._latest]).alias("latest"))
        return rows.groupBy(self._place().alias("file"), *self._by).agg(*aggs)

    def commit(
        self,
        added: DataFrame | None = None,
        deleted: DataFrame | None = None,
        properties: dict[str, str] | None = None,
        overwrite: bool = False,
        expect: int | None = None,
        replaced: DataFrame | None = None,
    ) -> int:
        """Make the next version: ``added`` rows in new files, ``deleted`` positions (``__file, __row``
        as :meth:`read` gives them), ``replaced`` files (``file``) taken out, or with ``overwrite`` all
        files. Properties are carried on and updated.

        Another commit in between (or a latest version other than ``expect``) is a precondition error,
        and nothing of this one is visible.
        """
        before = self.version()
        if expect is not None and before != expect:
            raise StatusError(Status.PRECONDITION, f"version {before}, expected {expect}")
        version, token = before + 1, uuid.uuid4().hex
        old = self._entry(before)
        entry = {"files": [], "gone": [], "entries": [], "vectors": []} if overwrite else {k: list(old[k]) for k in ("files", "gone", "entries", "vectors")}
        entry["properties"] = {**old["properties"], **(properties or {})}

        def part(kind: str, frame: DataFrame, name: str) -> None:
            frame.write.parquet(f"{self.path}/_manifests/{token}-{name}")
            entry[kind].append(f"{token}-{name}")

        if added is not None:
            folder = f"{version:012d}-{token}"
            self._write(added, folder)
            fs, p = hadoop_path(self.spark, f"{self.path}/data/{folder}")
            every = F.lit(sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(p))).cast("long").alias("n_files")
            told = self._described(folder)
            if self._by:
                part("entries", told, "entries")
                told = self._parts(entry["entries"][-1:], self._entry_schema()).groupBy("file").agg(F.sum("n_rows").alias("n_rows"))
            part("files", told.select("*", every), "files")
            if self._ordered and not self._by:
                entry["entries"].append(entry["files"][-1])
        if replaced is not None and not overwrite:
            part("gone", replaced.select("file").distinct(), "gone")
        if deleted is not None:
            gone = deleted.select(F.col("__file").alias("file"), F.col("__row").alias("row"), F.lit(version).cast("long").alias("version")).distinct()
            part("vectors", gone, "deleted")
        if len(entry["files"]) + len(entry["gone"]) + len(entry["vectors"]) > MERGE_PARTS:
            live = self._kept(self._parts(entry["files"], _MANIFEST), entry)
            merged = {"files": live, "vectors": self._parts(entry["vectors"], _VECTORS).join(live.select("file"), "file", "left_semi")}
            if self._ordered:
                merged["entries"] = self._kept(self._parts(entry["entries"], self._entry_schema()), entry)
            for kind, frame in merged.items():
                entry[kind] = []
                part(kind, frame.hint("rebalance"), f"all-{kind}")
            entry["gone"] = []
        self._publish(version, token, json.dumps(entry))
        return version

    def _publish(self, version: int, token: str, text: str) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, temporary = hadoop_path(self.spark, f"{self.path}/_versions/.{token}")
        out = fs.create(temporary, False)
        jvm.org.apache.commons.io.IOUtils.write(text, out, "UTF-8")
        out.close()
        target = hadoop_path(self.spark, self._version_file(version))[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(target), no_options)
        except Exception as e:
            raise StatusError(Status.PRECONDITION, f"version {version} was committed by another") from e

    # Changes

    def changes(self, since: int, until: int | None = None, net: bool = False) -> DataFrame:
        """Rows of the table's columns and ``change`` (insert or delete) between two versions.

        With ``net``, rows that were only moved to other files (compaction) cancel out; equal rows are
        counted, not listed, so this is one aggregation.
        """
        until = self.version() if until is None else until
        old, new = self.manifest(since), self.manifest(until)
        v_old, v_new = self.vectors(since), self.vectors(until)
        cols = [F.col(f"`{f.name}`") for f in self.schema.fields]
        added = self._live(new.join(old, "file", "left_anti"), v_new).select(*cols, F.lit("insert").alias("change"))
        removed = self._live(old.join(new, "file", "left_anti"), v_old).select(*cols, F.lit("delete").alias("change"))
        fresh = v_new.filter(F.col("version") > since)
        touched = old.join(new.select("file"), "file", "left_semi").join(fresh, "file", "left_semi")
        hits = fresh.select(F.col("file").alias("__file"), F.col("row").alias("__row"))
        marked = self._rows(touched, True).join(hits, ["__file", "__row"], "left_semi").select(*cols, F.lit("delete").alias("change"))
        out = added.unionByName(removed).unionByName(marked)
        if not net:
            return out
        sign = F.when(F.col("change") == "insert", 1).otherwise(-1)
        counted = out.groupBy(*cols).agg(F.sum(sign).alias("__n")).filter("__n <> 0")
        many = counted.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n"))))
        return many.select(*cols, F.when(F.col("__n") > 0, "insert").otherwise("delete").alias("change"))

    def compact(self, files: int, least_dead: float = 0.0) -> int:
        """Rewrite the live rows into about ``files`` files; with ``least_dead`` only those of files of
        which at least that share is deleted."""
        if least_dead <= 0:
            return self.commit(added=self.read().repartition(files), overwrite=True)
        at = self.version()
        dead = self.vectors(at).groupBy("file").agg(F.count(F.lit(1)).alias("dead"))
        worn = self.manifest(at).join(dead, "file").filter(F.col("dead") >= F.lit(least_dead) * F.col("n_rows")).select("file")
        return self.commit(added=self.read(at, files=worn).repartition(files), replaced=worn, expect=at)


def process_new(
    source: VersionedTable, sink: VersionedTable, consumer: str, fn: Callable[[DataFrame], DataFrame], net: bool = True
) -> tuple[int, int] | None:
    """One run of a consumer: the changes of ``source`` since its last successful run go through ``fn``
    and are committed to ``sink`` together with the version processed. Returns the two versions, or
    None when there was nothing new. A run that fails anywhere has no effect."""
    at = sink.version()
    done = int(sink.properties(at).get(f"processed.{consumer}", 0))
    latest = source.version()
    if latest == done:
        return None
    out = fn(source.changes(done, latest, net))
    sink.commit(added=out, properties={f"processed.{consumer}": str(latest)}, expect=at)
    return done, latest


def folder_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, changed`` of the Parquet files of a folder (or one file); nothing of them is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return listed.select(_plain("path").alias("path"), "length", F.col("modificationTime").alias("changed"))


def _plain(path: str) -> Column:
    """A file's address in one spelling."""
    return F.regexp_replace(F.col(path), "^file:/+", "file:/")


def ingest(store: VersionedTable, folder: str, rows: Callable[[DataFrame], DataFrame], source: str = "source") -> DataFrame | None:
    """One run of taking a folder of immutable Parquet files into ``store``, which has a column ``source``
    for the file a row came from. The folder's manifest is diffed against the one of the last run: rows
    of added files go through ``rows`` and are added, rows of removed or rewritten files are deleted, and
    the manifest is saved in the same commit, so a run that fails has no effect and none is repeated.
    Returns the frame of the files read (None if none were), after the commit.
    """
    spark, at = store.spark, store.version()
    token = uuid.uuid4().hex
    place = f"{store.path}/_manifests/{token}-source"
    folder_manifest(spark, folder).write.parquet(place)
    now = spark.read.schema(_SOURCES).parquet(place)
    before = store.properties(at).get(f"manifest.{source}")
    done = spark.read.schema(_SOURCES).parquet(f"{store.path}/_manifests/{before}") if before else spark.createDataFrame([], _SOURCES)
    key = ["path", "length", "changed"]
    names = [r.path for r in now.join(done, key, "left_anti").select("path").collect()]  # the new files of this run
    lost = done.join(now, key, "left_anti").select(F.col("path").alias(source))
    n_lost = lost.count() if before else 0
    if not names and not n_lost:
        return None
    fresh = spark.read.parquet(*names) if names else None
    added = None if fresh is None else rows(fresh.withColumn(source, _plain("_metadata.file_path")))
    deleted = store.read(at, positions=True).join(lost, source, "left_semi") if n_lost else None
    store.commit(added=added, deleted=deleted, properties={f"manifest.{source}": f"{token}-source"}, expect=at)
    return fresh
