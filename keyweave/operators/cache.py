"""Retention by recency: what an LRU cache of fixed slots holds after a stream of writes."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 32


def slot_capacity(capacity: int, slots: int = SLOTS) -> int:
    return capacity // slots + 1


def lru_retain(accesses: DataFrame, key: str, seq: str, capacity: int, slot: Column | None = None, slots: int = SLOTS) -> DataFrame:
    """Keys a cache holds after writes of ``key`` in the order of ``seq``: ``slot, key, last_seq, rank``.

    Every write promotes or inserts, so a slot holds its ``slot_capacity`` most recent distinct keys,
    whatever was evicted in between: exact without replaying. Last writes combine map-side, and the
    window keeps at most the capacity per task and slot before the shuffle. Null keys are left out.
    """
    where = slot if slot is not None else F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    last = accesses.filter(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(seq).alias("last_seq"))
    w = Window.partitionBy("slot").orderBy(F.desc("last_seq"), key)
    ranked = last.select(where.alias("slot"), F.col(key), "last_seq").withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= slot_capacity(capacity, slots))


class LRUCache:
    """Cache of fixed capacity for one process; reading promotes."""

    def __init__(self, capacity: int) -> None:
        self._capacity, self._data = capacity, OrderedDict()

    def __len__(self) -> int:
        return len(self._data)

    def get(self, key, default=None):
        if key not in self._data:
            return default
        self._data.move_to_end(key)
        return self._data[key]

    def add(self, key, value) -> None:
        self._data[key] = value
        self._data.move_to_end(key)
        while len(self._data) > self._capacity:
            self._data.popitem(last=False)

    def items(self) -> Iterable[tuple]:
        return iter(self._data.items())


class DoubleLRUCache:
    """Two caches: new entries are warm, entries read again are hot; the hot ones' oldest become warm."""

    def __init__(self, hot: int, warm: int) -> None:
        self._hot, self._warm, self._hot_capacity = OrderedDict(), LRUCache(warm), hot

    def __len__(self) -> int:
        return len(self._hot) + len(self._warm)

    def add(self, key, value) -> None:
        if key in self._hot:
            self._hot[key] = value
            self._hot.move_to_end(key)
        else:
            self._warm.add(key, value)

    def get(self, key, default=None):
        if key in self._hot:
            self._hot.move_to_end(key)
            return self._hot[key]
        value = self._warm._data.pop(key, self)
        if value is self:
            return default
        self._hot[key] = value
        while len(self._hot) > self._hot_capacity:
            self._warm.add(*self._hot.popitem(last=False))
        return value
