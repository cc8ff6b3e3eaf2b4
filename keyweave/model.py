"""Record model, statuses and key orders."""

from __future__ import annotations

from collections.abc import Callable
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions import codecs, strings

#: Between words: all but letters, combining marks and digits of any script.
NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


class Status(StrEnum):
    """Outcome of an operation on a record; in frames it is a string column."""

    SUCCESS = "SUCCESS"
    UNKNOWN = "UNKNOWN_ERROR"
    SYSTEM = "SYSTEM_ERROR"
    NOT_IMPLEMENTED = "NOT_IMPLEMENTED_ERROR"
    PRECONDITION = "PRECONDITION_ERROR"
    INVALID_ARGUMENT = "INVALID_ARGUMENT_ERROR"
    CANCELED = "CANCELED_ERROR"
    NOT_FOUND = "NOT_FOUND_ERROR"
    PERMISSION = "PERMISSION_ERROR"
    INFEASIBLE = "INFEASIBLE_ERROR"
    DUPLICATION = "DUPLICATION_ERROR"
    BROKEN_DATA = "BROKEN_DATA_ERROR"
    NETWORK = "NETWORK_ERROR"
    APPLICATION = "APPLICATION_ERROR"


class StatusError(Exception):
    """A status other than success, raised."""

    def __init__(self, status: Status, message: str = "") -> None:
        super().__init__(f"{status}: {message}" if message else str(status))
        self.status = status


def status(cond_ok: Column, failure: Status) -> Column:
    return F.when(cond_ok, F.lit(str(Status.SUCCESS))).otherwise(F.lit(str(failure)))


def batch_status(results: DataFrame, order: str = "seq") -> DataFrame:
    """One row: the first failure of a batch in ``order``, or success."""
    bad = F.expr(f"min_by(status, struct(`{order}`, status)) FILTER (WHERE status <> 'SUCCESS')")
    return results.agg(F.coalesce(bad, F.lit(str(Status.SUCCESS))).alias("status"))


# Key orders. Each gives the sort keys of a key column; the first entries also say which keys are
# one record (keys that compare equal).


def _float_order(b: Column) -> list[Column]:
    """NaN first, then by value; from the bit pattern, so that no Python is needed."""
    raw = codecs.big_endian_to_int(b)
    bits = F.when(F.length(b) == 4, F.shiftleft(raw, 32)).otherwise(raw)
    size = F.bitwise_not(F.lit(-(2**63))).bitwiseAND(bits)
    is_nan = size > F.lit(0x7FF0000000000000)
    is_nan = F.when(F.length(b) == 4, size > F.lit(0x7F800000 << 32)).otherwise(is_nan)
    return [F.when(is_nan, 0).otherwise(1), F.when(is_nan, F.lit(0)).when(bits < 0, -size).otherwise(size)]


def _signed_order(b: Column) -> list[Column]:
    n, raw = F.length(b), codecs.big_endian_to_int(b)
    value = raw
    for size in (1, 2, 4):
        value = F.when(n == size, F.when(raw >= 2 ** (8 * size - 1), raw - 2 ** (8 * size)).otherwise(raw)).otherwise(value)
    return [value]


ORDERS = {
    "lexical": lambda k: [k],
    "lexicalcase": lambda k: [strings.lower_ascii(k)],
    "decimal": lambda k: [strings.to_int(k)],
    "hexadecimal": lambda k: [strings.to_int_hex(k)],
    "realnumber": lambda k: [strings.to_double(k)],
    "signedbigendian": _signed_order,
    "floatbigendian": _float_order,
}


#: An order: its name, or a function from a key column to the columns to sort by.
Order = str | Callable[[Column], list[Column]]


def sort_keys(order: Order, key: Column, second: Column | None = None) -> list[Column]:
    """Sort keys of an order by name, case-insensitively, with or without ``keycomparator`` at its
    end. ``pair...`` orders compare ``second`` by its bytes after the key. Where keys compare equal
    without being the same, callers add the key itself for a fixed order."""
    if callable(order):
        return order(key)
    name = order.lower().removesuffix("keycomparator")
    pair = name.startswith("pair")
    if pair and second is None:
        raise StatusError(Status.INVALID_ARGUMENT, f"{order} needs a second column")
    name = name.removeprefix("pair")
    if name not in ORDERS:
        raise StatusError(Status.INVALID_ARGUMENT, f"no such order: {order}")
    return ORDERS[name](key) + ([second] if pair else [])


def identity(order: Order, key: Column) -> Column:
    """What makes two keys the same record in an order."""
    keys = sort_keys(order, key)
    return keys[0] if len(keys) == 1 else F.struct(*keys)
