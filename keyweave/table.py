"""A stored key-value table with the whole record interface; every change is a new version.

Opened by :func:`open_table` from a path and parameters: ``dbm`` picks the kind (hash, tree, skip,
tiny, baby, cache, std...; by default the path's extension, if it names one), which decides whether
keys are ordered and whether records live for the session (a table in its scratch) or in a versioned table.

A change of some keys reads only the files that may hold them (each commit is sorted by key, and its
files' ends are in the manifest), marks their old records in a deletion vector and adds their new ones
in a new file; no file is rewritten until :meth:`KVTable.rebuild`.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions import hashes
from keyweave.model import Order, Status, StatusError, batch_status, identity
from keyweave.operators import cache, changefeed, changelog, point, reduce, scan, search, shard
from keyweave.operators.point import KEY, VALUE
from keyweave.session import hadoop_path, materialize, release, scratch_scope
from keyweave.sources import records
from keyweave.sources.versioned import VersionedTable

log = logging.getLogger("keyweave")

KINDS = ("hash", "tree", "skip", "tiny", "baby", "cache", "stdhash", "stdtree")
ORDERED = ("tree", "skip", "baby", "stdtree")
IN_MEMORY = ("tiny", "baby", "cache", "stdhash", "stdtree")


class _Removed:
    """What a processor returns to remove the record."""


REMOVE = _Removed()


def open_table(spark: SparkSession, path: str = "", schema: str = "key string, value string", **params) -> KVTable:
    """``dbm`` names the kind, else an extension that is a kind's name does; neither gives a hash table,
    or without a path a table in memory."""
    named = str(params.pop("dbm", "")).lower().removesuffix("dbm")
    extension = path.rpartition(".")[2].lower()
    kind = named or (extension if extension in KINDS else "hash" if path else "tiny")
    if kind not in KINDS:
        raise StatusError(Status.INVALID_ARGUMENT, f"no such kind: {kind}")
    return KVTable(spark, path, schema, kind, **params)


class KVTable:
    """Unique keys with values. Methods that change it return the status of the batch or of each row."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        kind: str,
        *,
        key_comparator: Order = "lexical",
        cap_rec_num: int = 1 << 20,
        log: Callable[[DataFrame], None] | None = None,
        writable: bool = True,
    ) -> None:
        self.spark, self.path, self.kind, self.order = spark, path, kind, key_comparator
        self._capacity, self._log, self._may_write = cap_rec_num, log, writable
        self._memory = kind in IN_MEMORY or not path
        self._store = None if self._memory else VersionedTable(spark, path, schema, ordered_by=[KEY])
        self._frame = spark.createDataFrame([], schema) if self._memory else None
        self._frames: list[DataFrame] = []
        self._uses: DataFrame | None = None
        self._clock = 0
        self._pending: DataFrame | None = None
        self.is_open = True

    # State

    @property
    def is_ordered(self) -> bool:
        return self.kind in ORDERED

    @property
    def is_healthy(self) -> bool:
        return self.is_open

    @property
    def is_writable(self) -> bool:
        return self.is_open and self._may_write

    def df(self) -> DataFrame:
        """All records, in key order if the table is ordered and they are asked for in order."""
        if not self.is_open:
            raise StatusError(Status.PRECONDITION, "not open")
        return self._frame if self._memory else self._store.read()

    def _check_writable(self) -> None:
        if not self.is_writable:
            raise StatusError(Status.PRECONDITION, "not writable")

    def _keep(self, frame: DataFrame) -> None:
        """The records of a table in memory: written to the shared folder, so that lineage ends there and
        no executor is missed. States that frames of before may still read go when the table is closed."""
        self._frame = materialize(frame, "memory", kept=True)
        self._frames.append(self._frame)

    def _replace(self, new: DataFrame, logged: DataFrame | None = None) -> None:
        """Publish a new state of the whole table. The changes are handed to the logger first."""
        self._check_writable()
        if self._log is not None:
            self._log(changelog.capture(self.df(), new) if logged is None else logged)
        if self._memory:
            self._keep(new)
            self._evict()
        else:
            self._store.commit(new, overwrite=True)

    def _near(self, keys: DataFrame, version: int) -> DataFrame:
        """Records of some keys with their positions, from the files that may hold such keys."""
        lo, hi = keys.agg(F.min(KEY), F.max(KEY)).head()
        files = self._store.entries(version).filter((F.col("hi")[KEY] >= F.lit(lo)) & (F.col("lo")[KEY] <= F.lit(hi)))
        return self._store.read(version, positions=True, files=files).join(keys, KEY, "left_semi")

    def _update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Change the records of ``keys``: ``change`` maps those that exist to what they shall be."""
        self._check_writable()
        touched = keys.select(KEY).filter(F.col(KEY).isNotNull()).distinct()
        with scratch_scope():
            touched = materialize(touched, "keys")
            at = 0 if self._memory else self._store.version()
            old = materialize(self._frame.join(touched, KEY, "left_semi") if self._memory else self._near(touched, at), "touched")
            new = materialize(change(old.select(KEY, VALUE)), "changed")
            if self._log is not None:
                self._log(changelog.capture(old.select(KEY, VALUE), new))
            if not self._memory:
                self._store.commit(added=new, deleted=old, expect=at)
                return
            whole = self._frame.join(touched, KEY, "left_anti").unionByName(new.select(*self._frame.columns))
            self._frame = materialize(whole, "memory", kept=True)
            self._frames.append(self._frame)
            self._used(self._keys_of(touched))
            self._evict()

    def _keys_of(self, keys: DataFrame) -> DataFrame:
        """Keys that outlive the scratch they were written to, where a cache has to remember them."""
        return materialize(keys.select(KEY), "used", kept=True) if self.kind == "cache" else keys

    # A cache holds the most recently used records of each slot; reading is a use.

    def _used(self, keys: DataFrame) -> None:
        if self.kind == "cache":
            self._clock += 1
            now = keys.select(F.col(KEY), F.lit(self._clock).cast("long").alias("seq"))
            self._uses = now if self._uses is None else self._uses.unionByName(now)

    def _evict(self) -> None:
        if self.kind != "cache":
            return
        all_ = self._frame.select(F.col(KEY), F.lit(0).cast("long").alias("seq"))
        uses = all_ if self._uses is None else self._uses.join(all_.select(KEY), KEY, "left_semi").unionByName(all_)
        self._uses = materialize(uses.groupBy(KEY).agg(F.max("seq").alias("seq")), "uses", kept=True)
        self._frames.append(self._uses)
        held = cache.lru_retain(self._uses, KEY, "seq", self._capacity, hashes.cache_slot_of(shard.hashed_bytes(self._uses, KEY), cache.SLOTS).cast("int"))
        self._keep(self._frame.join(held.select(KEY), KEY, "left_semi"))

    def close(self) -> None:
        self.is_open = False
        for f in self._frames:
            release(f)
        self._frames = []

    def _types(self) -> tuple[str, str]:
        s = self._frame.schema if self._memory else self._store.schema
        return s[KEY].dataType.simpleString(), s[VALUE].dataType.simpleString()

    def _ops(self, items: dict | Sequence[tuple] | DataFrame) -> DataFrame:
        if isinstance(items, DataFrame):
            return items
        pairs = list(items.items()) if isinstance(items, dict) else list(items)
        k, v = self._types()
        return self.spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], f"key {k}, value {v}, seq long")

    def _keys(self, keys: Sequence | DataFrame) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys
        return self.spark.createDataFrame([(k,) for k in keys], f"key {self._types()[0]}")

    def _resolved(self, keyed: DataFrame, *names: str) -> DataFrame:
        """Keys that compare equal to a stored key are that record: they get its spelling; among new
        keys that compare equal the least is the spelling."""
        if not callable(self.order) and self.order.lower().removesuffix("keycomparator") == "lexical":
            return keyed
        names = names or (KEY,)
        held = self.df().select(identity(self.order, F.col(KEY)).alias("__id"), F.col(KEY).alias("__held"))
        asked = keyed
        for n in names:
            asked = asked.withColumn(f"__id_{n}", identity(self.order, F.col(n)))
        spelled = None
        for n in names:
            one = asked.select(F.col(f"__id_{n}").alias("__id"), F.col(n).alias("__first"))
            spelled = one if spelled is None else spelled.unionByName(one)
        spelled = spelled.groupBy("__id").agg(F.min("__first").alias("__first")).join(held, "__id", "left").select("__id", F.coalesce("__held", "__first").alias("__as"))
        for n in names:
            to = spelled.select(F.col("__id").alias(f"__id_{n}"), F.col("__as").alias(f"__as_{n}"))
            asked = asked.join(to, f"__id_{n}", "left").withColumn(n, F.coalesce(f"__as_{n}", n))
        return asked.select(*keyed.columns)

    # Reading

    def _record(self, key):
        found = point.get_multi(self.df(), self._resolved(self._keys([key]))) if self.order != "lexical" else point.get(self._near_one(key), key)
        return found.head()

    def _near_one(self, key) -> DataFrame:
        """What may hold a key: for a stored table its files whose ends enclose it."""
        if self._memory or not self.is_open:
            return self.df()
        at = self._store.version()
        files = self._store.entries(at).filter((F.col("hi")[KEY] >= F.lit(key)) & (F.col("lo")[KEY] <= F.lit(key)))
        return self._store.read(at, files=files)

    def get(self, key, default=None):
        row = self._record(key)
        if row is not None:
            self._used(self._keys([row[KEY]]))
        return default if row is None else row[VALUE]

    def get_multi(self, keys) -> DataFrame:
        asked = self._resolved(self._keys(keys))
        self._used(asked)
        return point.get_multi(self.df(), asked)

    def get_multi_status(self, keys) -> DataFrame:
        return point.get_multi_status(self.df(), self._resolved(self._keys(keys)))

    def count(self) -> int:
        return self.df().count()

    def file_size(self) -> int:
        """Bytes of the stored table; 0 in memory."""
        if self._memory:
            return 0
        fs, p = hadoop_path(self.spark, self.path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def timestamp(self) -> float:
        """Seconds since the epoch of the last change of a stored table; NaN without one."""
        version = 0 if self._memory else self._store.version()
        if not version:
            return float("nan")
        fs, p = hadoop_path(self.spark, self._store._version_file(version))
        return fs.getFileStatus(p).getModificationTime() / 1000

    def inspect(self) -> DataFrame:
        kind = self.spark.createDataFrame([("class", self.kind), ("path", self.path), ("order", str(self.order)), ("file_size", str(self.file_size()))], "name string, value string")
        return kind.unionByName(point.inspect(self.df()).withColumn("value", F.col("value").cast("string")))

    def search(self, mode: str, pattern: str, capacity: int = 0) -> DataFrame:
        return search.search(self.df(), mode, pattern, capacity, order=self.order)

    def range(self, mode: str, bound, capacity: int = 0) -> DataFrame:
        return scan.range_scan(self.df(), mode, bound, capacity, self.order)

    def first(self, n: int = 1) -> DataFrame:
        return scan.first(self.df(), n, self.order)

    def last(self, n: int = 1) -> DataFrame:
        return scan.last(self.df(), n, self.order)

    def get_by_index(self, i: int) -> DataFrame:
        return point.get_by_index(self.df(), i, self.order)

    # Writing

    def set_multi(self, items, overwrite: bool = True) -> Status:
        ops = self._resolved(self._ops(items))
        status = Status.SUCCESS if overwrite else Status(batch_status(point.set_status(self.df(), ops, False)).head()[0])
        self._update(ops, lambda old: point.set_multi(old, ops, overwrite))
        return status

    def set(self, key, value, overwrite: bool = True) -> Status:
        return self.set_multi([(key, value)], overwrite)

    def remove_multi(self, keys) -> Status:
        keys = self._resolved(self._keys(keys))
        missing = point.get_multi_status(self.df(), keys).filter("NOT found").limit(1).count()
        self._update(keys, lambda old: old.select(KEY, VALUE).limit(0))
        return Status.NOT_FOUND if missing else Status.SUCCESS

    def remove(self, key) -> Status:
        return self.remove_multi([key])

    def append_multi(self, items, delim: str = "") -> Status:
        ops = self._resolved(self._ops(items))
        self._update(ops, lambda old: point.append_multi(old, ops, delim))
        return Status.SUCCESS

    def append(self, key, value, delim: str = "") -> Status:
        return self.append_multi([(key, value)], delim)

    def increment(self, key, by: int = 1, initial: int = 0) -> int | None:
        """Decimal-text or long values; returns the new number, modulo 2**64. The least 64-bit integer as
        ``by`` only reads the number, None without a record."""
        old = self._record(key)
        number = None if old is None else int(old[VALUE] or 0)
        if by == -(2**63):
            return number
        new = (initial if number is None else number) + by
        new = (new + 2**63) % 2**64 - 2**63
        self.set(key if old is None else old[KEY], new if self._types()[1] == "bigint" else str(new))
        return new

    def compare_exchange_multi(self, ops: DataFrame) -> Status:
        """All or nothing; see :func:`keyweave.operators.point.compare_exchange_multi`."""
        ops = self._resolved(ops)
        failed = point.compare_exchange_status(self.df(), ops).filter("status <> 'SUCCESS'").limit(1).count()
        if failed:
            return Status.INFEASIBLE
        self._update(ops, lambda old: point.compare_exchange_multi(old, ops))
        return Status.SUCCESS

    def compare_exchange(self, key, expected, desired, expected_kind: str = "value", desired_kind: str = "value") -> Status:
        k, v = self._types()
        schema = f"key {k}, expected_kind string, expected {v}, desired_kind string, desired {v}"
        return self.compare_exchange_multi(self.spark.createDataFrame([(key, expected_kind, expected, desired_kind, desired)], schema))

    def process_multi(self, ops: DataFrame, delim: str = "") -> None:
        ops = self._resolved(ops)
        self._update(ops, lambda old: point.process_multi(old, ops, delim))

    def process_each(self, value: Column, keep: Column | None = None, begin: Callable[[], None] | None = None, end: Callable[[], None] | None = None) -> None:
        """``begin`` and ``end`` are called on the driver before the first and after the last record."""
        if begin is not None:
            begin()
        self._replace(point.process_each(self.df(), value, keep))
        if end is not None:
            end()

    def process(self, fn, keys=None) -> None:
        if keys is None:
            self._replace(point.process(self.df(), fn))
        else:
            asked = self._resolved(self._keys(keys))
            self._update(asked, lambda old: point.process(old, fn, asked))

    def _processed(self, row, fn: Callable[[object, object], object]) -> Status:
        """Hand a record to ``fn(key, value)``: None leaves it, :data:`REMOVE` removes it, else the value
        is set."""
        if row is None:
            return Status.NOT_FOUND
        done = fn(row[KEY], row[VALUE])
        if done is REMOVE:
            return self.remove(row[KEY])
        return Status.SUCCESS if done is None else self.set(row[KEY], done)

    def process_first(self, fn: Callable[[object, object], object]) -> Status:
        return self._processed(point.first_records(self.df(), 1, self.order).head(), fn)

    def rekey(self, old_key, new_key, overwrite: bool = True, copying: bool = False) -> Status:
        k = self._types()[0]
        ops = self._resolved(self.spark.createDataFrame([(old_key, new_key)], f"old_key {k}, new_key {k}"), "old_key", "new_key")
        both = ops.select(F.col("old_key").alias(KEY)).unionByName(ops.select(F.col("new_key").alias(KEY)))
        status = Status(point.rekey_status(self.df(), ops, overwrite).head()["status"])
        if status == Status.SUCCESS:
            self._update(both, lambda old: point.rekey(old, ops, overwrite, copying))
        return status

    def pop_first(self) -> tuple | None:
        row = point.first_records(self.df(), 1, self.order).head()
        if row is not None:
            self.remove(row[KEY])
        return None if row is None else (row[KEY], row[VALUE])

    def push_last(self, pushes: DataFrame) -> None:
        self._check_writable()
        self._replace(point.push_last(self.df(), pushes))

    def cursor(self) -> Cursor:
        return Cursor(self)

    # Batches with reducers: new records are invisible until synchronize.

    def insert(self, rows: DataFrame) -> None:
        self._pending = rows if self._pending is None else self._pending.unionByName(rows)

    def revert(self) -> None:
        self._pending = None

    def synchronize(self, reducer: str | None = "last", merged: Sequence[DataFrame] = (), after: Callable[[str], None] | None = None) -> None:
        if self._pending is not None or merged:
            self._replace(reduce.synchronize(self.df(), self._pending, reducer, merged))
            self._pending = None
        if after is not None:
            after(self.path)

    # Whole tables

    def clear(self) -> None:
        none = self.df().select(KEY, VALUE).limit(0)
        cleared = self.spark.range(1).select(F.lit("CLEAR").alias("op"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in none.schema.fields])
        self._replace(none, cleared)

    def rebuild(self, files: int = 1) -> None:
        if self._store is not None:
            self._store.compact(files)

    def should_be_rebuilt(self) -> bool:
        """More rows lie in the files than live (twice and more)."""
        if self._store is None:
            return False
        held = self._store.manifest().agg(F.coalesce(F.sum("n_rows"), F.lit(0))).head()[0]
        return shard.should_rebuild({"file_bytes": held, "live_bytes": self.count()})

    def copy(self, path: str) -> None:
        """A snapshot as plain Parquet, range-sorted by key if the table is ordered."""
        df = self.df()
        (df.repartitionByRange(F.col(KEY)).sortWithinPartitions(KEY) if self.is_ordered else df).write.mode("overwrite").parquet(path)

    def export(self, other: KVTable) -> None:
        other._replace(point.export_merge([other.df(), self.df()]))

    def export_flat(self, path: str, keys_only: bool = False) -> None:
        records.export_flat(self.df(), path, keys_only)

    def import_flat(self, path: str) -> None:
        kinds = self.df().schema
        rows = records.import_flat(self.spark, path)
        typed = rows.select(*[F.col(c).cast(kinds[c].dataType).alias(c) for c in (KEY, VALUE)], F.monotonically_increasing_id().alias("seq"))
        typed = materialize(typed, "imported")  # the place of a record is read once
        self._update(typed, lambda old: point.set_multi(old, typed))

    def export_tsv(self, path: str, escape: bool = False) -> None:
        records.export_tsv(self.df(), path, escape)

    def import_tsv(self, path: str, unescape: bool = False) -> None:
        rows = records.import_tsv(self.spark, path, unescape).withColumn("seq", F.lit(0))
        self._update(rows, lambda old: point.set_multi(old, rows))

    def export_key_lines(self, path: str) -> None:
        records.export_key_lines(self.df(), path)

    def apply_log(self, log: DataFrame, server_id: int = changelog.EVERYTHING, dbm_index: int = changelog.EVERYTHING, min_timestamp: int | None = None) -> None:
        wanted = changelog.wanted(log, server_id, dbm_index, min_timestamp)
        clears = wanted.filter(changefeed.normalize_op(F.col("op")) == "CLEAR").limit(1).count()
        if clears:
            self._replace(changelog.replay(self.df(), wanted))
        else:
            wanted = self._resolved(wanted)
            self._update(wanted, lambda old: changelog.replay(old, wanted))

    def retain(self, accesses: DataFrame, seq: str = "seq") -> None:
        """Keep what a cache of this capacity would hold after the accesses (``key``, ``seq``)."""
        held = cache.lru_retain(accesses, KEY, seq, self._capacity)
        self._replace(self.df().join(held.select(KEY), KEY, "left_semi"))


class Cursor:
    """A place among the records of a table, in key order; it stays when the record goes. Positions are
    found by range scans that read at most one record."""

    def __init__(self, table: KVTable) -> None:
        self._table, self._key = table, None

    def _to(self, frame: DataFrame) -> Status:
        row = frame.head()
        self._key = None if row is None else row[KEY]
        return Status.NOT_FOUND if row is None else Status.SUCCESS

    def first(self) -> Status:
        return self._to(self._table.first(1))

    def last(self) -> Status:
        return self._to(self._table.last(1))

    def jump(self, key) -> Status:
        """To the first record not below ``key``."""
        return self._to(self._table.range("upperinc", key, 1))

    def jump_upper(self, key, inclusive: bool = False) -> Status:
        return self._to(self._table.range("upperinc" if inclusive else "upper", key, 1))

    def jump_lower(self, key, inclusive: bool = False) -> Status:
        return self._to(self._table.range("lowerinc" if inclusive else "lower", key, 1))

    def _step(self, mode: str) -> Status:
        return Status.NOT_FOUND if self._key is None else self._to(self._table.range(mode, self._key, 1))

    def next(self) -> Status:
        return self._step("upper")

    def previous(self) -> Status:
        return self._step("lower")

    def get(self) -> tuple | None:
        """The record here: (key, value); None off the ends, or if it was removed meanwhile."""
        row = None if self._key is None else self._table._record(self._key)
        return None if row is None else (row[KEY], row[VALUE])

    def step(self) -> tuple | None:
        """The record here, and on to the next."""
        found = self.get()
        self.next()
        return found

    def set(self, value) -> Status:
        return Status.NOT_FOUND if self.get() is None else self._table.set(self._key, value)

    def remove(self) -> Status:
        """Remove the record here and move to the next."""
        if self.get() is None:
            return Status.NOT_FOUND
        gone = self._key
        self.next()
        return self._table.remove(gone)

    def process(self, fn: Callable[[object, object], object]) -> Status:
        row = None if self._key is None else self._table._record(self._key)
        return self._table._processed(row, fn)


def restore(spark: SparkSession, path: str, schema: str = "key string, value string") -> DataFrame:
    """Records of a damaged table: those of its latest version whose manifest is readable, removals
    honoured, less what lies in broken or missing data files. If no version is readable, all data files
    count and the last written one wins per key."""
    store = VersionedTable(spark, path, schema, ordered_by=[KEY])
    settings = {f"spark.sql.files.ignore{x}Files": "true" for x in ("Corrupt", "Missing")}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for version in range(store.version(), 0, -1):
            try:
                return materialize(store.read(version).select(KEY, VALUE), "restored")
            except Exception as e:
                log.warning("version %d of %s cannot be read: %s", version, path, e)
        df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/data")
        rows = df.select(KEY, VALUE, F.col("_metadata.file_path").alias("f"))
        return materialize(rows.groupBy(KEY).agg(F.max_by(F.struct(VALUE), "f")[VALUE].alias(VALUE)), "restored")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
