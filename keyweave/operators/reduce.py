"""Sort-merge-reduce: values of a key, from several runs in a fixed order, to one or no value.

Rows are (key, value) with ``seq`` inside a run and ``source_rank`` of the run; merged runs come
first, then the table, then new records. Most reducers are aggregates that combine map-side, so a hot
key costs one row per task; the concatenating ones hold what their result holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions import codecs, strings
from keyweave.model import NO_WORD, Status, StatusError
from keyweave.operators.point import KEY, VALUE


def _at() -> Column:
    """Place of a row among those of its key."""
    return F.struct("source_rank", "seq")


def merge_runs(base: DataFrame, pending: DataFrame | None = None, merged: Sequence[DataFrame] = ()) -> DataFrame:
    """All runs as one frame ``key, seq, value, op, source_rank``: merged runs in turn, the table,
    new records. A run without ``seq`` has one record per key; ``op`` is SET unless a run has its own."""
    runs = [*merged, base, *([pending] if pending is not None else [])]
    out = None
    for rank, r in enumerate(runs):
        seq = F.col("seq").cast("long") if "seq" in r.columns else F.lit(0).cast("long")
        op = F.col("op") if "op" in r.columns else F.lit("SET")
        run = r.select(F.col(KEY), seq.alias("seq"), F.col(VALUE), op.alias("op"), F.lit(rank).alias("source_rank")).filter(F.col(KEY).isNotNull())
        out = run if out is None else out.unionByName(run)
    return out


def drop_removed(rows: DataFrame) -> DataFrame:
    """Keep what comes after a key's last tombstone (``op`` REMOVE); tombstones go too."""
    dead = rows.filter("op = 'REMOVE'").groupBy(KEY).agg(F.max(_at()).alias("dead"))
    j = rows.filter("op <> 'REMOVE'").join(dead, KEY, "left")
    return j.filter(F.col("dead").isNull() | (_at() > F.col("dead"))).drop("dead")


def _text(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit(""))


def _concat(sep: str) -> Callable[[], Column]:
    parts = lambda: F.array_sort(F.collect_list(F.struct("source_rank", "seq", _text(F.col(VALUE)).alias("v"))))
    return lambda: F.array_join(F.transform(parts(), lambda p: p["v"]), sep)


def _total_big_endian() -> Column:
    total = F.sum(codecs.unsigned(codecs.big_endian_to_int(F.col(VALUE))).cast("decimal(38,0)"))
    m = F.pmod(total, F.expr("18446744073709551616BD"))
    signed = F.when(m >= F.expr("9223372036854775808BD"), m - F.expr("18446744073709551616BD")).otherwise(m)
    return codecs.int_to_big_endian(signed.cast("long"))


_AGGREGATES: dict[str, Callable[[], Column]] = {
    "first": lambda: F.min_by(F.struct(VALUE), _at())[VALUE],
    "last": lambda: F.max_by(F.struct(VALUE), _at())[VALUE],
    "concat": _concat(""),
    "concatnull": _concat("\0"),
    "concattab": _concat("\t"),
    "concatline": _concat("\n"),
    "total": lambda: F.sum(strings.to_int(_text(F.col(VALUE))).cast("decimal(38,0)")).cast("string"),
    "totalbe": _total_big_endian,
}
# Other names of the reducers.
ALIASES = {
    "reducetofirst": "first", "reducetosecond": "second", "reducetolast": "last", "reduceconcat": "concat", "reduceconcatwithnull": "concatnull",
    "reduceconcatwithtab": "concattab", "reduceconcatwithline": "concatline", "reducetotal": "total", "reducetototal": "total", "reducetototalbigendian": "totalbe",
    "reduceremove": "remove", "totalbigendian": "totalbe",
}
REDUCERS = (*_AGGREGATES, "second", "remove")


def reduce_rows(rows: DataFrame, reducer: str) -> DataFrame:
    """One record per key by a named reducer; ``remove`` keeps every row after the last tombstone.

    ``second`` gives the first where there is no second. Null values concatenate as empty and total
    as 0; totals are exact beyond 64 bits. Rows of equal rank and seq are taken in value order where
    values are joined, and in no fixed order elsewhere. Empty input gives no rows.
    """
    name = ALIASES.get(reducer.lower(), reducer.lower())
    if name == "remove":
        return drop_removed(rows).select(KEY, VALUE)
    if name == "second":
        first = rows.groupBy(KEY).agg(F.min(_at()).alias("at"), F.min_by(F.struct(VALUE), _at()).alias("one"))
        rest = rows.join(first, KEY).filter(_at() > F.col("at"))
        second = rest.groupBy(KEY).agg(F.min_by(F.struct(VALUE), _at()).alias("two"))
        j = first.join(second, KEY, "left")
        return j.select(KEY, F.when(F.col("two").isNotNull(), F.col("two")[VALUE]).otherwise(F.col("one")[VALUE]).alias(VALUE))
    if name not in _AGGREGATES:
        raise StatusError(Status.INVALID_ARGUMENT, f"no such reducer: {reducer}")
    return rows.groupBy(KEY).agg(_AGGREGATES[name]().alias(VALUE))


def synchronize(base: DataFrame, pending: DataFrame | None, reducer: str | None = "last", merged: Sequence[DataFrame] = ()) -> DataFrame:
    """The new table: runs merged, removed records dropped, values reduced; without a reducer
    duplicates stay."""
    rows = drop_removed(merge_runs(base, pending, merged))
    return rows.select(KEY, VALUE) if reducer is None else reduce_rows(rows, reducer)


def reduce_with(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """User reducer: gets the rows of a key in order and returns any number of records. A key's values
    must fit a task; for keys beyond that, cut them with :mod:`keyweave.operators.chunking`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(["source_rank", "seq"], kind="stable"))

    return rows.groupBy(KEY).applyInPandas(run, schema)


def word_count(docs: DataFrame, text: str, pattern: str = NO_WORD) -> DataFrame:
    """Map to (word, 1) and reduce to totals: ``key, value``; words as in :func:`index.build_inverted`."""
    words = docs.select(F.explode(F.split(F.lower(text), pattern)).alias(KEY)).filter(F.col(KEY) != "")
    return words.groupBy(KEY).agg(F.count(F.lit(1)).alias(VALUE))
