"""Ordered access: range scans with a limit, steps to neighbours, whole-table order.

A cursor is a declarative range here: a filter on the key that reaches the scan, an order and a
limit, which Spark runs as one bounded top-k per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyweave.model import Status, StatusError, sort_keys
from keyweave.operators.point import KEY
from keyweave.session import materialize

MODES = ("upper", "upperinc", "lower", "lowerinc")


def range_scan(df: DataFrame, mode: str, bound, capacity: int = 0, order: str = "lexical", key: str = KEY) -> DataFrame:
    """Records above (``upper``) or below (``lower``) a bound, with it (``inc``) or without, nearest
    first; ``capacity`` 0 is unlimited. ``rank`` counts from 1 when there is a capacity.

    Keys that compare equal are ordered by the key itself. Null keys are not in any range.
    """
    if mode not in MODES:
        raise StatusError(Status.INVALID_ARGUMENT, f"no such mode: {mode}")
    k, b = sort_keys(order, F.col(key)), sort_keys(order, F.lit(bound))
    left, right = (k[0], b[0]) if len(k) == 1 else (F.struct(*[c.alias(f"c{i}") for i, c in enumerate(k)]), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(b)]))
    cond = {"upper": left > right, "upperinc": left >= right, "lower": left < right, "lowerinc": left <= right}[mode]
    down = mode.startswith("lower")
    by = [c.desc() if down else c.asc() for c in [*k, F.col(key)]]
    found = df.filter(F.col(key).isNotNull() & cond).orderBy(*by)
    if not capacity:
        return found
    # Already at most ``capacity`` rows: the rank costs one small task.
    return found.limit(capacity).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))


def first(df: DataFrame, n: int = 1, order: str = "lexical", key: str = KEY) -> DataFrame:
    return df.orderBy(*sort_keys(order, F.col(key)), key).limit(n)


def last(df: DataFrame, n: int = 1, order: str = "lexical", key: str = KEY) -> DataFrame:
    return df.orderBy(*[c.desc() for c in [*sort_keys(order, F.col(key)), F.col(key)]]).limit(n)


def jump(df: DataFrame, bound, n: int = 1, order: str = "lexical", key: str = KEY) -> DataFrame:
    """The first ``n`` records not below the bound."""
    return range_scan(df, "upperinc", bound, n, order, key)


def next_record(df: DataFrame, current, order: str = "lexical", key: str = KEY) -> DataFrame:
    return range_scan(df, "upper", current, 1, order, key)


def previous_record(df: DataFrame, current, order: str = "lexical", key: str = KEY) -> DataFrame:
    return range_scan(df, "lower", current, 1, order, key)


def in_order(df: DataFrame, order: str = "lexical", key: str = KEY) -> DataFrame:
    """All records in key order: a range exchange and a sort, also across shards."""
    return df.orderBy(*sort_keys(order, F.col(key)), key)


def neighbours(df: DataFrame, order: str = "lexical", key: str = KEY) -> DataFrame:
    """Every key with the one before and after it: ``key, previous, next`` (null at the ends).

    Keys are range-partitioned; windows run inside the ranges, and the ranges' ends, one row each, are
    stitched together. Null keys are left out; equal keys are neighbours of each other.
    """
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    ranged = keys.repartitionByRange(*sort_keys(order, F.col("k")), "k").withColumn("part", F.spark_partition_id())
    placed = materialize(ranged, "ranges").withColumn("at", F.struct(*[c.alias(f"a{i}") for i, c in enumerate([*sort_keys(order, F.col("k")), F.col("k")])]))
    ends = placed.groupBy("part").agg(F.min_by("k", "at").alias("first"), F.max_by("k", "at").alias("last"))
    across = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per shuffle partition
    ends = ends.select(F.col("part").alias("p"), F.lag("last").over(across).alias("before"), F.lead("first").over(across).alias("after"))
    inside = Window.partitionBy("part").orderBy("at")
    near = placed.withColumn("l", F.lag("k").over(inside)).withColumn("r", F.lead("k").over(inside))
    joined = near.join(ends, F.col("part") == F.col("p"))
    return joined.select(F.col("k").alias(key), F.coalesce("l", "before").alias("previous"), F.coalesce("r", "after").alias("next"))
