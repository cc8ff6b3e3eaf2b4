"""Update logs: encoding and decoding of entries, filtering by origin, capture and replay."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.codecs import get_varint, put_varint
from keyweave.model import Status
from keyweave.operators.changefeed import apply_changes, normalize_op
from keyweave.operators.point import KEY, VALUE

# First byte of an entry by its kind.
MAGIC = {"SET": 0xA1, "REMOVE": 0xA2, "CLEAR": 0xA3}
_KIND = {v: k for k, v in MAGIC.items()}
#: Filter value that lets everything pass.
EVERYTHING = -(2**31) + 1
ENTRY = "status string, op string, server_id int, dbm_index int, key binary, value binary"


def encode_entry(op: str, server_id: int, dbm_index: int, key: bytes = b"", value: bytes = b"") -> bytes:
    head = bytes([MAGIC[op]]) + put_varint(server_id) + put_varint(dbm_index)
    if op == "SET":
        return head + put_varint(len(key)) + put_varint(len(value)) + key + value
    return head + put_varint(len(key)) + key if op == "REMOVE" else head


def decode_entry(data: bytes | None) -> tuple:
    """(status, op, server, index, key, value); what cannot be an entry is broken data."""
    broken = (str(Status.BROKEN_DATA), None, None, None, None, None)
    if data is None or len(data) < 3 or data[0] not in _KIND:
        return broken
    numbers, at = [], 1
    for _ in range({"SET": 4, "REMOVE": 3, "CLEAR": 2}[_KIND[data[0]]]):
        n, after = get_varint(data, at)
        if after == at:
            return broken
        numbers.append(n)
        at = after
    origin = [n - 2**32 if n >= 2**31 else n for n in (x & 0xFFFFFFFF for x in numbers[:2])]
    sizes = numbers[2:]
    if sizes and sum(sizes) != len(data) - at:
        return broken
    key = data[at : at + sizes[0]] if sizes else None
    value = data[at + sizes[0] :] if len(sizes) == 2 else None
    return (str(Status.SUCCESS), _KIND[data[0]], *origin, key, value)


def parse_entries(message: Column) -> Column:
    """Struct of status, op, server_id, dbm_index, key, value for each binary message."""

    @F.pandas_udf(ENTRY)
    def run(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([decode_entry(x) for x in s], columns=[c.split()[0] for c in ENTRY.split(", ")])
        return out.astype({"server_id": "Int32", "dbm_index": "Int32"})

    return run(message)


def origin_matches(col: Column, wanted: int) -> Column:
    """n >= 0 only n; a negative number all but its opposite; :data:`EVERYTHING` all."""
    if wanted == EVERYTHING:
        return F.lit(True)
    return col == wanted if wanted >= 0 else col != -wanted


def filter_origin(log: DataFrame, server_id: int = EVERYTHING, dbm_index: int = EVERYTHING) -> DataFrame:
    """Entries of the wanted origins; the others are infeasible and skipped, clears among them."""
    return log.filter(origin_matches(F.col("server_id"), server_id) & origin_matches(F.col("dbm_index"), dbm_index))


def wanted(log: DataFrame, server_id: int = EVERYTHING, dbm_index: int = EVERYTHING, min_timestamp: int | None = None) -> DataFrame:
    """Entries of the wanted origins, not older than the minimum."""
    some = filter_origin(log, server_id, dbm_index)
    return some if min_timestamp is None else some.filter(F.col("ts") >= min_timestamp)


def apply_status(log: DataFrame, server_id: int = EVERYTHING, dbm_index: int = EVERYTHING) -> DataFrame:
    """``seq, status`` of applying each entry: broken, infeasible or a success (a missing key is one)."""
    ok = origin_matches(F.col("server_id"), server_id) & origin_matches(F.col("dbm_index"), dbm_index)
    known = normalize_op(F.col("op")).isNotNull()
    s = F.when(~known, str(Status.BROKEN_DATA)).when(ok, str(Status.SUCCESS)).otherwise(str(Status.INFEASIBLE))
    return log.select("seq", s.alias("status"))


def replay(
    base: DataFrame, log: DataFrame, server_id: int = EVERYTHING, dbm_index: int = EVERYTHING, min_timestamp: int | None = None
) -> DataFrame:
    """One table (key, value) after a log ``ts, seq, op, server_id, dbm_index, key, value``, all of
    whose wanted entries apply to it in the order of ``seq``; a clear discards the base too."""
    filled = wanted(log, server_id, dbm_index, min_timestamp).withColumn(VALUE, F.coalesce(F.col(VALUE), F.lit("").cast(base.schema[VALUE].dataType)))
    return apply_changes(filled, scope=[], key=KEY, seq="seq", op="op", fields=[VALUE], base=base.select(KEY, VALUE)).select(KEY, VALUE)


def capture(before: DataFrame, after: DataFrame) -> DataFrame:
    """The log that turns one table into another: ``op, key, value`` (SET changed and new records,
    REMOVE missing ones)."""
    b = before.select(KEY, F.struct(VALUE).alias("b"))
    j = b.join(after.select(KEY, F.struct(VALUE).alias("a")), KEY, "full")
    changed = F.col("a").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))
    op = F.when(F.col("a").isNull(), "REMOVE").when(changed, "SET")
    return j.select(op.alias("op"), KEY, F.col("a")[VALUE].alias(VALUE)).filter("op IS NOT NULL")


def once_cleared(log: DataFrame) -> DataFrame:
    """A log of shards with every clear kept only from the first shard (``dbm_index`` 0)."""
    return log.filter((normalize_op(F.col("op")) != "CLEAR") | (F.col("dbm_index") == 0) | F.col("op").isNull())
