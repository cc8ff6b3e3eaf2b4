"""Per-key results over keys of very unequal size, by exact offset chunking.

Rows are cut into input blocks of equal size along the order column, keys are counted per block,
the counts are prefix-summed to offsets, and every row gets its exact number within its key. Chunks
of at most ``chunk_rows`` consecutive rows of one key are the unit of work; each leaves a boundary
state, and the states of a key are merged in order. No task ever holds more than one chunk of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.session import materialize

#: Rows of one key that one task processes at once.
CHUNK_ROWS = 50_000
#: Rows per input block, and the most quantiles that are literals of the plan. More blocks than
#: quantiles are made by cutting each quantile range evenly.
BLOCK_ROWS, MAX_QUANTILES = 500_000, 64


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[f"__{n}"])
    return on


def block_of(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> Column:
    """Number of the input block of a row, growing with ``order``; null ``order`` is in the first.

    Quantiles of ``order`` give ranges of equal size, which are cut evenly into as many blocks as the
    row count needs. Blocks only balance the work: offsets are counted exactly for whatever they are.
    """
    return _blocks(df, order, block_rows)[0]


def _blocks(df: DataFrame, order: str, block_rows: int) -> tuple[Column, int]:
    """(the block of a row, rows of ``df``), after one scan of ``order``."""
    at = [i / MAX_QUANTILES for i in range(1, MAX_QUANTILES)]
    total, n, lo, hi, inner = df.select(F.count(F.lit(1)), F.count(order), F.min(order), F.max(order), F.percentile_approx(order, at, 10_000)).head()
    blocks = max(1, -(-n // block_rows))
    if blocks == 1:
        return F.lit(0).cast("long"), total
    ranges = min(MAX_QUANTILES, blocks)
    inner = [inner[i * MAX_QUANTILES // ranges - 1] for i in range(1, ranges)]
    ends = [*sorted({x for x in inner if x < hi}), hi]
    parts = -(-blocks // ranges)

    def leaf(i: int) -> Column:
        start = lo if i == 0 else ends[i - 1] + 1
        step = max(1, -(-(ends[i] - start + 1) // parts))
        return F.lit(i * parts).cast("long") + F.floor((F.col(order) - F.lit(start)) / F.lit(step))

    def tree(first: int, last: int) -> Column:
        if first == last:
            return leaf(first)
        mid = (first + last) // 2
        return F.when(F.col(order) <= F.lit(ends[mid]), tree(first, mid)).otherwise(tree(mid + 1, last))

    return F.coalesce(tree(0, len(ends) - 1), F.lit(0).cast("long")), total


def chunk_keys(
    df: DataFrame, keys: Sequence[str], order: str, *, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``df`` with ``__chunk``: rows of a key in ``order`` are cut into chunks of ``chunk_rows`` rows.

    ``order`` is a unique integer column; rows with equal or null ``order`` are numbered in no
    particular order among themselves (null first). Null keys are a key. Keys with at most
    ``chunk_rows`` rows are a single chunk 0, so only the few longer keys (at most rows/chunk_rows of
    them) have their rows numbered.
    """
    return _chunked(df, keys, order, chunk_rows, block_rows)[0]


def _chunked(df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    names = df.columns
    work = df.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the input can clash
    ks, o = [f"c{names.index(k)}" for k in keys], f"c{names.index(order)}"
    block, total = _blocks(work, o, block_rows)
    placed = work.withColumn("block", block)
    counts = placed.groupBy(*ks, "block").agg(F.count(F.lit(1)).alias("n"))
    per_key = Window.partitionBy(*ks)
    before = per_key.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("total", F.sum("n").over(per_key))
        .filter(F.col("total") > chunk_rows)
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"__{k}") for k in ks], F.col("block").alias("__block"), "offset")
    )
    # Written first: at most rows/chunk_rows keys, whose size is known when the joins are planned. Small,
    # it is broadcast, and then only rows of long keys move, to be numbered block by block.
    offsets = materialize(offsets, "offsets")
    long_keys = offsets.select(*[f"__{k}" for k in ks]).distinct()
    local = Window.partitionBy(*ks, "block").orderBy(o)
    long_rows = placed.join(offsets, _same(placed, offsets, [*ks, "block"])).withColumn(
        "chunk", F.floor((F.col("offset") + F.row_number().over(local) - 1) / F.lit(chunk_rows)).cast("long")
    )
    short_rows = work.join(long_keys, _same(work, long_keys, ks), "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    both = long_rows.select(*work.columns, "chunk").unionByName(short_rows)
    return both.toDF(*names, "__chunk"), total


def apply_chunks(chunked: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user function once per chunk; it sees at most ``chunk_rows`` rows and returns a state
    that carries the keys and ``__chunk`` for the ordered merge."""
    return chunked.groupBy(*keys, "__chunk").applyInPandas(fn, schema)


def ordered_profile(
    df: DataFrame, keys: Sequence[str], order: str, value: str, *, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per key: ``n`` rows, ``first_order``, ``last_order``, ``last_value``, and ``n_switches``, how often
    the value differs from the row before (null equals null).

    The last three depend on the order of the rows, across chunk borders too: every chunk leaves
    (first value, last value, inner switches), and the merge compares neighbours. Empty input gives
    no rows.
    """
    keys = list(keys)
    slim = df.select(*keys, F.col(order).alias("__o"), F.col(value).alias("__v"))
    chunked = chunk_keys(slim, keys, "__o", chunk_rows=chunk_rows, block_rows=block_rows)
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__o")
    lagged = chunked.withColumn("__first", F.row_number().over(inside) == 1).withColumn(
        "__switch", F.when(~F.col("__first") & ~F.lag("__v").over(inside).eqNullSafe(F.col("__v")), 1).otherwise(0)
    )
    states = lagged.groupBy(*keys, "__chunk").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__o").alias("__lo"),
        F.max("__o").alias("__hi"),
        F.min_by("__v", "__o").alias("__fv"),
        F.max_by("__v", "__o").alias("__lv"),
        F.sum("__switch").alias("__sw"),
    )
    chain = Window.partitionBy(*keys).orderBy("__chunk")
    merged = states.withColumn(
        "__edge",
        F.when((F.row_number().over(chain) > 1) & ~F.lag("__lv").over(chain).eqNullSafe(F.col("__fv")), 1).otherwise(0),
    )
    return merged.groupBy(*keys).agg(
        F.sum("__n").alias("n"),
        F.min("__lo").alias("first_order"),
        F.max("__hi").alias("last_order"),
        F.max_by("__lv", "__hi").alias("last_value"),
        (F.sum("__sw") + F.sum("__edge")).cast("long").alias("n_switches"),
    )


def heavy_keys(df: DataFrame, keys: Sequence[str], order: str, share: float, **sizes: int) -> DataFrame:
    """Keys with more than ``share`` of all rows: ``keys..., n, n_chunks``, from merged chunk counts."""
    slim = df.select(*keys, order)
    chunked, total = _chunked(slim, keys, order, **sizes)
    states = chunked.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    merged = states.groupBy(*keys).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_chunks"))
    return merged.filter(F.col("n") > F.lit(share * total))
