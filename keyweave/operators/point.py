"""Record operators on a table of unique keys, in batches.

A table is a frame with a key and a value column; an operation batch is a frame of its own, with
``seq`` giving the order where it matters. Results are new frames: the changed table, or one row per
operation with its status. Keys are never null (null keys of a batch are ignored); values may be.
Only the named columns take part, so other columns and their names do not matter. Batches join the
table on the key with no hint: Spark broadcasts a side only if it measures small, and AQE splits
hot keys. Batches are first reduced to one row per key by map-side combining aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.functions import codecs
from keyweave.model import Status, sort_keys, status
from keyweave.session import materialize

KEY, VALUE = "key", "value"


def kv(df: DataFrame, key: str = KEY, value: str = VALUE) -> DataFrame:
    """The (key, value) view of any frame."""
    return df.select(F.col(key).alias(KEY), F.col(value).alias(VALUE))


def _keys(keys: DataFrame) -> DataFrame:
    return keys.select(F.col(KEY)).filter(F.col(KEY).isNotNull()).distinct()


def _base(base: DataFrame) -> DataFrame:
    return base.select(F.col(KEY), F.col(VALUE).alias("old"), F.lit(True).alias("found"))


# Reading


def get(df: DataFrame, key) -> DataFrame:
    """The record of one key; the equality reaches the scan."""
    return df.filter(F.col(KEY) == F.lit(key)).select(KEY, VALUE)


def get_multi(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of the keys that exist; repeated keys collapse."""
    return df.select(KEY, VALUE).join(_keys(keys), KEY, "left_semi")


def get_multi_status(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, value, found, status`` for every distinct key asked for."""
    joined = _keys(keys).join(_base(df), KEY, "left")
    found = F.coalesce("found", F.lit(False))
    return joined.select(KEY, F.col("old").alias(VALUE), found.alias("found"), status(found, Status.NOT_FOUND).alias("status"))


def get_simple(df: DataFrame, keys: DataFrame, default) -> DataFrame:
    """Values with a default for missing keys; a stored null stays null."""
    s = get_multi_status(df, keys)
    return s.select(KEY, F.when(F.col("found"), F.col(VALUE)).otherwise(F.lit(default)).alias(VALUE))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


#: Records up to which :func:`get_by_index` takes a bounded top-k instead of counting ranges.
TOP_ROWS = 10_000


def get_by_index(df: DataFrame, index: int, order: str = "lexical") -> DataFrame:
    """The ``index``-th record (from 0) in key order; none beyond the end or below 0.

    Far records are found by counting: keys are range-partitioned, the ranges' counts are summed up, and
    only the range that holds the record is sorted."""
    rows = df.select(KEY, VALUE)
    by = [*sort_keys(order, F.col(KEY)), F.col(KEY)]
    if index < 0:
        return rows.limit(0)
    if index < TOP_ROWS:
        return rows.orderBy(*by).offset(index).limit(1)
    placed = materialize(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    before = 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect()):  # a row per range
        if index < before + n:
            here = placed.filter(F.col("__part") == part)
            place = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
            return here.withColumn("__at", place).filter(F.col("__at") == index - before + 1).select(KEY, VALUE)
        before += n
    return rows.limit(0)


# Writing


def _first_or_last(ops: DataFrame, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    per_key = ops.filter(F.col(KEY).isNotNull()).groupBy(KEY)
    return per_key.agg(pick(F.struct(VALUE), "seq").alias("v")).select(KEY, F.col("v")[VALUE].alias(VALUE))


def set_multi(base: DataFrame, ops: DataFrame, overwrite: bool = True) -> DataFrame:
    """Upsert; of several values for a key the last by ``seq`` stays, without ``overwrite`` the first,
    and existing records are left alone."""
    new = _first_or_last(ops, overwrite)
    old = base.select(KEY, VALUE)
    if overwrite:
        return old.join(new, KEY, "left_anti").unionByName(new)
    return old.unionByName(new.join(old, KEY, "left_anti"))


def set_status(base: DataFrame, ops: DataFrame, overwrite: bool = True) -> DataFrame:
    """``key, seq, existed, old_value, status`` per operation, as if applied in order: without
    ``overwrite`` all but the first for a new key are duplications. ``old_value`` is the table's."""
    first = ops.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min("seq").alias("first"))
    joined = ops.select(KEY, "seq").join(first.join(_base(base), KEY, "left"), KEY)
    existed = F.coalesce("found", F.lit(False)) | (F.col("seq") > F.col("first"))
    ok = F.lit(True) if overwrite else ~existed
    return joined.select(KEY, "seq", existed.alias("existed"), F.col("old").alias("old_value"), status(ok, Status.DUPLICATION).alias("status"))


def remove_multi(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.select(KEY, VALUE).join(_keys(keys), KEY, "left_anti")


def remove_status(base: DataFrame, keys: DataFrame) -> DataFrame:
    s = get_multi_status(base, keys)
    return s.select(KEY, F.col(VALUE).alias("old_value"), "status")


def append_multi(base: DataFrame, ops: DataFrame, delim: str = "") -> DataFrame:
    """Append values in the order of ``seq``, the delimiter only between; null values append nothing
    but still create the record."""
    parts = F.array_sort(F.collect_list(F.struct("seq", VALUE)))
    tail = F.array_join(F.transform(parts, lambda p: p[VALUE]), delim)
    new = ops.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(tail.alias("tail"), F.count(VALUE).alias("n"))
    joined = base.select(KEY, VALUE, F.lit(True).alias("found")).join(new, KEY, "full")
    value = (
        F.when(F.coalesce("n", F.lit(0)) == 0, F.coalesce(VALUE, F.when(F.col("found").isNull(), F.lit(""))))
        .when(F.col(VALUE).isNull(), F.col("tail"))
        .otherwise(F.concat(F.col(VALUE), F.lit(delim), F.col("tail")))
    )
    return joined.select(KEY, value.alias(VALUE))


def increment_multi(base: DataFrame, ops: DataFrame, initial: int = 0) -> DataFrame:
    """Long values: new = (old or ``initial``) + sum of increments; a stored null counts as 0. Sums
    wrap at 64 bits. Null increments add 0 but create the record."""
    total = ops.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(_wrapped(F.sum(F.coalesce(VALUE, F.lit(0)).cast("decimal(38,0)"))).alias("inc"))
    joined = base.select(KEY, F.coalesce(F.col(VALUE).cast("long"), F.lit(0)).alias("old")).join(total, KEY, "full")
    new = _wrapped(F.coalesce("old", F.lit(initial)).cast("decimal(38,0)") + F.col("inc").cast("decimal(38,0)"))
    return joined.select(KEY, F.when(F.col("inc").isNull(), F.col("old")).otherwise(new).alias(VALUE))


def _wrapped(d: Column) -> Column:
    """A decimal sum as a 64-bit integer, modulo 2**64."""
    m = F.pmod(d, F.expr("18446744073709551616BD"))
    return F.when(m >= F.expr("9223372036854775808BD"), m - F.expr("18446744073709551616BD")).otherwise(m).cast("long")


def increment_bytes(base: DataFrame, ops: DataFrame, initial: int = 0) -> DataFrame:
    """As :func:`increment_multi` on big-endian binary values: 1 to 8 bytes are read, 8 are written;
    records without an operation keep their bytes."""
    numbers = base.select(KEY, codecs.big_endian_to_int(F.col(VALUE)).alias(VALUE))
    new = increment_multi(numbers.join(_keys(ops), KEY, "left_semi"), ops, initial)
    return base.select(KEY, VALUE).join(_keys(ops), KEY, "left_anti").unionByName(new.select(KEY, codecs.int_to_big_endian(F.col(VALUE)).alias(VALUE)))


# Compare and exchange: expected is 'absent', 'any' or 'value'; desired is 'remove', 'noop' or 'value'.


def _exchanged(base: DataFrame, ops: DataFrame) -> DataFrame:
    """Operations joined to the table: ``hit`` tells whether the expectation holds."""
    o = ops.select(KEY, F.col("expected_kind").alias("ek"), F.col("expected").alias("ev"), F.col("desired_kind").alias("dk"), F.col("desired").alias("dv"))
    j = _base(base).join(o.filter(F.col(KEY).isNotNull()).withColumn("op", F.lit(True)), KEY, "full")
    there = F.coalesce("found", F.lit(False))
    hit = (
        F.when(F.col("op").isNull(), F.lit(None).cast("boolean"))
        .when(F.col("ek") == "absent", ~there)
        .when(F.col("ek") == "any", there)
        .otherwise(there & F.col("old").eqNullSafe(F.col("ev")))
    )
    return j.withColumn("there", there).withColumn("hit", hit)


def _applied(j: DataFrame, go: Column) -> DataFrame:
    keep = F.col("there") & ~(go & (F.col("dk") == "remove"))
    make = go & (F.col("dk") == "value")
    return j.filter(keep | make).select(KEY, F.when(make, F.col("dv")).otherwise(F.col("old")).alias(VALUE))


def compare_exchange(base: DataFrame, ops: DataFrame) -> DataFrame:
    """Apply each operation whose expectation holds (one per key). Removing or keeping an absent
    record changes nothing and succeeds."""
    j = _exchanged(base, ops)
    return _applied(j, F.coalesce("hit", F.lit(False)))


def compare_exchange_status(base: DataFrame, ops: DataFrame) -> DataFrame:
    """``key, found, actual, status`` per operation."""
    j = _exchanged(base, ops).filter(F.col("hit").isNotNull())
    return j.select(KEY, F.col("there").alias("found"), F.col("old").alias("actual"), status(F.col("hit"), Status.INFEASIBLE).alias("status"))


def compare_exchange_multi(base: DataFrame, ops: DataFrame) -> DataFrame:
    """All operations or none: they are applied only if every expectation holds."""
    j = _exchanged(base, ops)
    all_hit = j.agg(F.coalesce(F.bool_and("hit"), F.lit(True))).scalar()
    return _applied(j, F.coalesce("hit", F.lit(False)) & all_hit)


def process_multi(base: DataFrame, ops: DataFrame, delim: str = "") -> DataFrame:
    """Many operations in the order of ``seq``, the same key any number of times.

    ``op`` is ``set``, ``add`` (set if absent), ``append`` or ``remove``. What stands before a key's
    last set or remove cannot matter, and after it only appends and the first add do, so the batch is
    reduced without replaying it row by row.
    """
    o = ops.filter(F.col(KEY).isNotNull() & F.col("op").isin("set", "add", "append", "remove")).select(KEY, "seq", "op", VALUE)
    absolute = F.expr("max_by(struct(seq, op, value), seq) FILTER (WHERE op IN ('set', 'remove'))")
    last = o.groupBy(KEY).agg(absolute.alias("a"))
    start = last.join(_base(base), KEY, "left").select(
        KEY,
        F.coalesce(F.col("a.seq"), F.lit(-(2**63))).alias("from"),
        F.when(F.col("a").isNull(), F.coalesce("found", F.lit(False))).otherwise(F.col("a.op") == "set").alias("there"),
        F.when(F.col("a").isNull(), F.col("old")).when(F.col("a.op") == "set", F.col("a.value")).alias("v0"),
    )
    later = o.join(start.select(KEY, "from", "there"), KEY).filter(F.col("seq") > F.col("from"))
    tail = later.groupBy(KEY).agg(
        F.min_by(F.struct("seq", VALUE), "seq").alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("op") == "append", F.struct("seq", VALUE)))).alias("appends"),
    )
    j = start.join(tail, KEY, "left")
    head = F.when(F.col("there"), F.col("v0")).otherwise(F.col("first")[VALUE])
    rest = F.filter(F.coalesce("appends", F.array().cast("array<struct<seq:bigint,value:string>>")), lambda p: F.col("there") | (p["seq"] > F.col("first")["seq"]))
    value = F.when(F.size(rest) > 0, F.concat_ws(delim, F.array(head), F.transform(rest, lambda p: p[VALUE]))).otherwise(head)
    new = j.filter(F.col("there") | F.col("first").isNotNull()).select(KEY, value.alias(VALUE))
    return base.select(KEY, VALUE).join(last.select(KEY), KEY, "left_anti").unionByName(new)


def process(base: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], keys: DataFrame | None = None) -> DataFrame:
    """User code on whole batches of records: gets and returns frames of (key, value); a record that
    is not returned is removed. With ``keys`` it only sees those (missing ones with a null value and
    ``found`` false) and the others stay."""
    schema = base.select(KEY, VALUE).schema
    if keys is None:
        return base.select(KEY, VALUE).mapInPandas(lambda it: (fn(p) for p in it), schema)
    asked = get_multi_status(base, keys).select(KEY, VALUE, "found")
    return remove_multi(base, keys).unionByName(asked.mapInPandas(lambda it: (fn(p) for p in it), schema))


def process_each(base: DataFrame, value: Column, keep: Column | None = None) -> DataFrame:
    """Rewrite every record by an expression of key and value; drop those where ``keep`` is not true."""
    kept = base if keep is None else base.filter(keep)
    return kept.select(KEY, value.alias(VALUE))


# Keys


def rekey(base: DataFrame, ops: DataFrame, overwrite: bool = True, copying: bool = False) -> DataFrame:
    """Rename records (``old_key``, ``new_key``; each key in one operation at most); operations that
    :func:`rekey_status` refuses change nothing."""
    good = rekey_status(base, ops, overwrite).filter("status = 'SUCCESS' AND old_key <> new_key")
    moved = good.join(base.select(F.col(KEY).alias("old_key"), VALUE), "old_key").select(F.col("new_key").alias(KEY), VALUE)
    rest = base.select(KEY, VALUE)
    if not copying:
        rest = rest.join(good.select(F.col("old_key").alias(KEY)), KEY, "left_anti")
    return rest.join(good.select(F.col("new_key").alias(KEY)), KEY, "left_anti").unionByName(moved)


def rekey_status(base: DataFrame, ops: DataFrame, overwrite: bool = True) -> DataFrame:
    """``old_key, new_key, status``: not found, or a duplication without ``overwrite``."""
    has = base.select(F.col(KEY).alias("old_key"), F.lit(True).alias("has_old"))
    taken = base.select(F.col(KEY).alias("new_key"), F.lit(True).alias("has_new"))
    j = ops.select("old_key", "new_key").join(has, "old_key", "left").join(taken, "new_key", "left")
    s = F.when(F.col("has_old").isNull(), str(Status.NOT_FOUND))
    if not overwrite:
        s = s.when(F.col("has_new") & (F.col("old_key") != F.col("new_key")), str(Status.DUPLICATION))
    return j.select("old_key", "new_key", s.otherwise(str(Status.SUCCESS)).alias("status"))


def first_records(base: DataFrame, n: int = 1, order: str = "lexical") -> DataFrame:
    return base.select(KEY, VALUE).orderBy(*sort_keys(order, F.col(KEY)), KEY).limit(n)


def pop_first(base: DataFrame, n: int = 1, order: str = "lexical") -> tuple[DataFrame, DataFrame]:
    """(the first ``n`` records, the table without them)."""
    first = first_records(base, n, order)
    return first, remove_multi(base, first)


def push_last(base: DataFrame, pushes: DataFrame) -> DataFrame:
    """Append values under time keys: ``pushes`` has ``wtime`` (seconds), ``seq`` and ``value``; keys
    are the 8 big-endian bytes of wtime * 1e8, moved up to the next free number.

    Numbers are given out among the free ones of each minute: a number's place is its value less the
    stored keys below it, pushes take the running maximum of their places, and the stored keys
    passed are added back. No minute can hold more than 6e9 keys.
    """
    n = F.floor(F.col("wtime") * F.lit(1e8)).cast("long")
    asked = pushes.select(n.alias("n"), "seq", VALUE, F.lit(0).alias("held"))
    minute = F.floor(F.col("n") / F.lit(6_000_000_000))
    times = asked.select(minute.alias("m")).distinct()
    stored = base.select(codecs.big_endian_to_int(F.col(KEY)).alias("n"), F.lit(None).cast("long").alias("seq"), VALUE, F.lit(1).alias("held"))
    both = asked.unionByName(stored.join(times, minute == F.col("m"), "left_semi")).withColumn("m", minute)

    minutes = Window.partitionBy("m")
    below = minutes.orderBy("n", "held", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumn("place", F.col("n") - F.coalesce(F.sum("held").over(below), F.lit(0)))
    own = Window.partitionBy("m", "held").orderBy("place", "seq")
    placed = placed.withColumn("i", F.row_number().over(own))
    top = F.max(F.col("place") - F.col("i")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("at", F.when(F.col("held") == 1, F.col("place")).otherwise(top + F.col("i")))
    passed = minutes.orderBy("at", F.desc("held")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("k", F.col("at") + F.sum("held").over(passed))
    new = numbered.filter("held = 0").select(codecs.int_to_big_endian(F.col("k")).alias(KEY), VALUE)
    return base.select(KEY, VALUE).unionByName(new)


def inspect(df: DataFrame) -> DataFrame:
    """(name, value) rows: records, bytes of keys and values, columns."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0))
    stats = df.agg(F.count(F.lit(1)).alias("num_records"), size(KEY).alias("key_bytes"), size(VALUE).alias("value_bytes"))
    return stats.select(F.stack(F.lit(3), *[x for c in ("num_records", "key_bytes", "value_bytes") for x in (F.lit(c), F.col(c))]).alias("name", "value"))


def export_merge(tables: Sequence[DataFrame]) -> DataFrame:
    """Records of all tables; for a key in several the last table's stays."""
    ranked = [t.select(KEY, VALUE).withColumn("seq", F.lit(i)) for i, t in enumerate(tables)]
    all_ = ranked[0]
    for t in ranked[1:]:
        all_ = all_.unionByName(t)
    return _first_or_last(all_, True)


def validate(df: DataFrame) -> DataFrame:
    """One row: records, null keys, and keys that are held more than once."""
    per_key = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_records"),
        F.coalesce(F.sum(F.when(F.col(KEY).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(F.col(KEY).isNotNull() & (F.col("n") > 1)).alias("repeated_keys"),
    )


def file_info(df: DataFrame) -> DataFrame:
    """Files a stored table is read from: path, bytes, time of change, rows."""
    m = F.col("_metadata")
    files = df.select(m.file_path.alias("path"), m.file_size.alias("size"), m.file_modification_time.alias("changed_at"))
    return files.groupBy("path", "size", "changed_at").agg(F.count(F.lit(1)).alias("n_rows"))
