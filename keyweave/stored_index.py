"""Secondary indices as stored tables: pairs of an index key and a primary key, sorted in every file.

Pairs are added and removed as rows: a change writes its pairs and deletion vectors only, and lookups
read the files whose ends enclose the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.model import Status
from keyweave.operators import index
from keyweave.operators.index import IKEY, PKEY
from keyweave.session import materialize, scratch_scope
from keyweave.sources.versioned import VersionedTable


class StoredIndex:
    """Distinct pairs under ``path``; ``types`` are those of the index key and the primary key."""

    def __init__(self, spark: SparkSession, path: str, types: tuple[str, str] = ("string", "string")) -> None:
        self.spark, self._types = spark, types
        self._store = VersionedTable(spark, path, f"{IKEY} {types[0]}, {PKEY} {types[1]}", ordered_by=[IKEY, PKEY])

    def df(self) -> DataFrame:
        return self._store.read()

    def _pairs(self, pairs: Sequence[tuple] | DataFrame) -> DataFrame:
        if isinstance(pairs, DataFrame):
            return pairs.select(IKEY, PKEY)
        return self.spark.createDataFrame(list(pairs), f"{IKEY} {self._types[0]}, {PKEY} {self._types[1]}")

    def _holding(self, lo, hi, positions: bool = False) -> DataFrame:
        """Pairs of the files that may hold index keys from ``lo`` to ``hi``."""
        at = self._store.version()
        files = self._store.entries(at).filter((F.col("hi")[IKEY] >= F.lit(lo)) & (F.col("lo")[IKEY] <= F.lit(hi)))
        return self._store.read(at, positions=positions, files=files)

    def add_multi(self, pairs) -> Status:
        """Idempotent: pairs that are held are not written again; null index keys are left out."""
        with scratch_scope():
            at = self._store.version()
            asked = materialize(self._pairs(pairs).filter(F.col(IKEY).isNotNull()).distinct(), "pairs")
            lo, hi = asked.agg(F.min(IKEY), F.max(IKEY)).head()
            self._store.commit(added=index.remove(asked, self._holding(lo, hi)), expect=at)
        return Status.SUCCESS

    def add(self, key, value) -> Status:
        return self.add_multi([(key, value)])

    def remove_multi(self, pairs) -> Status:
        with scratch_scope():
            at = self._store.version()
            asked = materialize(self._pairs(pairs).distinct(), "pairs")
            lo, hi = asked.agg(F.min(IKEY), F.max(IKEY)).head()
            gone = asked.select(F.col(IKEY).alias("i"), F.col(PKEY).alias("p"))
            held = self._holding(lo, hi, True)
            hit = materialize(held.join(gone, held[IKEY].eqNullSafe(gone.i) & held[PKEY].eqNullSafe(gone.p), "left_semi"), "hit")
            n = hit.count()
            if n:
                self._store.commit(deleted=hit, expect=at)
            return Status.SUCCESS if n else Status.NOT_FOUND

    def remove(self, key, value) -> Status:
        return self.remove_multi([(key, value)])

    def refresh(self, changed: DataFrame) -> None:
        """Follow changed records (``pkey, old_ikey, new_ikey``; null for a record that came or went): only
        their pairs are read and written."""
        moved = changed.filter(~F.col("old_ikey").eqNullSafe(F.col("new_ikey")))
        moved = materialize(moved, "moved")
        self.remove_multi(moved.filter("old_ikey IS NOT NULL").select(F.col("old_ikey").alias(IKEY), PKEY))
        self.add_multi(moved.select(F.col("new_ikey").alias(IKEY), PKEY))

    def check(self, key, value) -> bool:
        return not self._holding(key, key).filter((F.col(IKEY) == F.lit(key)) & F.col(PKEY).eqNullSafe(F.lit(value))).isEmpty()

    def get_values(self, key, max_values: int = 0) -> list:
        return [r[PKEY] for r in index.get_values(self._holding(key, key), key, max_values).toLocalIterator()]

    def count(self) -> int:
        return self.df().count()

    def clear(self) -> None:
        self._store.commit(self.df().limit(0), overwrite=True)

    def rebuild(self, files: int = 1) -> None:
        self._store.compact(files)

    def synchronize(self) -> Status:
        """Every change is durable when it returns."""
        return Status.SUCCESS

    def cursor(self) -> IndexCursor:
        return IndexCursor(self)


class IndexCursor:
    """A place among the pairs in their order; each step reads one pair by a bounded top-k."""

    def __init__(self, held: StoredIndex) -> None:
        self._index, self._at = held, None

    def _to(self, cond: Column | None, down: bool = False) -> Status:
        df = self._index.df()
        df = df if cond is None else df.filter(cond)
        row = df.orderBy(*[c.desc() if down else c.asc() for c in (F.col(IKEY), F.col(PKEY))]).head()
        self._at = None if row is None else (row[IKEY], row[PKEY])
        return Status.NOT_FOUND if row is None else Status.SUCCESS

    def first(self) -> Status:
        return self._to(None)

    def last(self) -> Status:
        return self._to(None, True)

    def jump(self, key, value=None) -> Status:
        """To the first pair not below (key, value)."""
        k, v = F.col(IKEY), F.col(PKEY)
        return self._to(k >= F.lit(key) if value is None else (k > F.lit(key)) | ((k == F.lit(key)) & (v >= F.lit(value))))

    def next(self) -> Status:
        if self._at is None:
            return Status.NOT_FOUND
        k, v = (F.lit(x) for x in self._at)
        return self._to((F.col(IKEY) > k) | ((F.col(IKEY) == k) & (F.col(PKEY) > v)))

    def previous(self) -> Status:
        if self._at is None:
            return Status.NOT_FOUND
        k, v = (F.lit(x) for x in self._at)
        return self._to((F.col(IKEY) < k) | ((F.col(IKEY) == k) & (F.col(PKEY) < v)), True)

    def get(self) -> tuple | None:
        return self._at
