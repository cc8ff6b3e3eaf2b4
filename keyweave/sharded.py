"""Hash-sharded tables: a record lives in the table that the hash of its key names.

Shard i of n of ``path`` is the table ``path-0000i-of-0000n``. A batch is split by shard and every part
goes to its table; whole-table reads are unions, which Spark reads in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.model import Status, StatusError
from keyweave.operators import changelog, point, scan, search
from keyweave.operators.point import KEY
from keyweave.operators.shard import shard_number, with_shard
from keyweave.session import hadoop_path
from keyweave.table import KVTable, open_table, restore


def shard_paths(spark: SparkSession, path: str) -> list[str]:
    """Paths of the shards that exist, in their order; [] without any."""
    parent, _, name = path.rpartition("/")
    fs, p = hadoop_path(spark, parent)
    found = {}
    for s in fs.listStatus(p) if fs.exists(p) else []:
        m = re.fullmatch(re.escape(name) + r"-(\d{5})-of-(\d{5})", s.getPath().getName())
        if m:
            found[int(m[2]), int(m[1])] = f"{parent}/{s.getPath().getName()}"
    counts = {n for n, _ in found}
    if len(counts) > 1 or any(len(found) != n for n in counts):
        raise StatusError(Status.BROKEN_DATA, f"incomplete shards of {path}")
    return [found[k] for k in sorted(found)]


class ShardedTable:
    """``num_shards`` tables as one; 0 takes those that exist."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "key string, value string", num_shards: int = 0, **params) -> None:
        held = shard_paths(spark, path)
        n = num_shards or len(held)
        if n < 1 or (held and len(held) != n):
            raise StatusError(Status.PRECONDITION, f"{len(held)} shards, asked for {n}")
        self.spark, self.path = spark, path
        self.shards: list[KVTable] = [open_table(spark, f"{path}-{i:05d}-of-{n:05d}", schema, **params) for i in range(n)]
        for s in self.shards:
            if s._store is not None and not s._store.version():
                s.clear()
        self.order = self.shards[0].order

    def shard_of(self, key) -> KVTable:
        return self.shards[shard_number(key, len(self.shards))]

    def _each(self, batch: DataFrame, run: Callable[[KVTable, DataFrame], object]) -> list:
        """Run on every shard with its part of a batch."""
        routed = with_shard(batch, len(self.shards), KEY)
        return [run(t, routed.filter(F.col("shard") == i).drop("shard")) for i, t in enumerate(self.shards)]

    @staticmethod
    def _worst(found: list[Status]) -> Status:
        return next((s for s in found if s != Status.SUCCESS), Status.SUCCESS)

    # Reading

    def df(self) -> DataFrame:
        all_ = self.shards[0].df()
        for t in self.shards[1:]:
            all_ = all_.unionByName(t.df())
        return all_

    def get(self, key, default=None):
        return self.shard_of(key).get(key, default)

    def get_multi(self, keys) -> DataFrame:
        return point.get_multi(self.df(), self.shards[0]._keys(keys))

    def count(self) -> int:
        return self.df().count()

    def search(self, mode: str, pattern: str, capacity: int = 0) -> DataFrame:
        return search.search(self.df(), mode, pattern, capacity, order=self.order)

    def range(self, mode: str, bound, capacity: int = 0) -> DataFrame:
        return scan.range_scan(self.df(), mode, bound, capacity, self.order)

    def first(self, n: int = 1) -> DataFrame:
        return scan.first(self.df(), n, self.order)

    def last(self, n: int = 1) -> DataFrame:
        return scan.last(self.df(), n, self.order)

    # Writing

    def set(self, key, value, overwrite: bool = True) -> Status:
        return self.shard_of(key).set(key, value, overwrite)

    def remove(self, key) -> Status:
        return self.shard_of(key).remove(key)

    def append(self, key, value, delim: str = "") -> Status:
        return self.shard_of(key).append(key, value, delim)

    def increment(self, key, by: int = 1, initial: int = 0) -> int | None:
        return self.shard_of(key).increment(key, by, initial)

    def compare_exchange(self, key, *args, **kwargs) -> Status:
        return self.shard_of(key).compare_exchange(key, *args, **kwargs)

    def set_multi(self, items, overwrite: bool = True) -> Status:
        return self._worst(self._each(self.shards[0]._ops(items), lambda t, part: t.set_multi(part, overwrite)))

    def remove_multi(self, keys) -> Status:
        return self._worst(self._each(self.shards[0]._keys(keys), lambda t, part: t.remove_multi(part)))

    def append_multi(self, items, delim: str = "") -> Status:
        return self._worst(self._each(self.shards[0]._ops(items), lambda t, part: t.append_multi(part, delim)))

    def compare_exchange_multi(self, ops: DataFrame) -> Status:
        """All or nothing: every expectation of every shard is checked before any shard changes."""
        failed = point.compare_exchange_status(self.df(), ops).filter("status <> 'SUCCESS'").limit(1).count()
        return Status.INFEASIBLE if failed else self._worst(self._each(ops, lambda t, part: t.compare_exchange_multi(part)))

    def process_multi(self, ops: DataFrame, delim: str = "") -> None:
        self._each(ops, lambda t, part: t.process_multi(part, delim))

    def rekey(self, old_key, new_key, overwrite: bool = True, copying: bool = False) -> Status:
        """Between shards the record is written to its new place first."""
        a, b = self.shard_of(old_key), self.shard_of(new_key)
        if a is b:
            return a.rekey(old_key, new_key, overwrite, copying)
        row = a._record(old_key)
        if row is None:
            return Status.NOT_FOUND
        status = b.set(new_key, row["value"], overwrite)
        return a.remove(old_key) if status == Status.SUCCESS and not copying else status

    def pop_first(self) -> tuple | None:
        row = self.first(1).head()
        if row is not None:
            self.remove(row["key"])
        return None if row is None else (row["key"], row["value"])

    def process_each(self, value, keep=None, begin: Callable[[], None] | None = None, end: Callable[[], None] | None = None) -> None:
        if begin is not None:
            begin()
        for t in self.shards:
            t.process_each(value, keep)
        if end is not None:
            end()

    def insert(self, rows: DataFrame) -> None:
        self._each(rows, lambda t, part: t.insert(part))

    def synchronize(self, reducer: str | None = "last", after: Callable[[str], None] | None = None) -> None:
        for t in self.shards:
            t.synchronize(reducer, after=after)

    def clear(self) -> None:
        for t in self.shards:
            t.clear()

    def rebuild(self, files: int = 1) -> None:
        for t in self.shards:
            t.rebuild(files)

    def apply_log(self, log: DataFrame, server_id: int = changelog.EVERYTHING, dbm_index: int = changelog.EVERYTHING, min_timestamp: int | None = None) -> None:
        """Entries go to the shard of their key, clears to all shards."""
        every = log.filter(F.col(KEY).isNull())
        routed = with_shard(log.filter(F.col(KEY).isNotNull()), len(self.shards), KEY)
        for i, t in enumerate(self.shards):
            t.apply_log(routed.filter(F.col("shard") == i).drop("shard").unionByName(every), server_id, dbm_index, min_timestamp)

    def close(self) -> None:
        for t in self.shards:
            t.close()


def restore_shards(spark: SparkSession, old_path: str, new_path: str, schema: str = "key string, value string") -> ShardedTable:
    """A new table from what can be read of every shard of a damaged one."""
    held = shard_paths(spark, old_path)
    if not held:
        raise StatusError(Status.NOT_FOUND, old_path)
    new = ShardedTable(spark, new_path, schema, len(held))
    for old, t in zip(held, new.shards):
        t._replace(restore(spark, old, schema))
    return new


def rename_shards(spark: SparkSession, old_path: str, new_path: str) -> Status:
    held = shard_paths(spark, old_path)
    if not held:
        return Status.NOT_FOUND
    for old in held:
        fs, p = hadoop_path(spark, old)
        if not fs.rename(p, hadoop_path(spark, new_path + old.removeprefix(old_path))[1]):
            return Status.SYSTEM
    return Status.SUCCESS
