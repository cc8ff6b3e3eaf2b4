"""Most frequent values by exact prefix refinement.

Values are hashed to 64 bits and counted by the first bits of the hash only. The count of a prefix
bounds the count of every value below it from above, so prefixes that cannot beat the current k-th
lower bound are dropped, the rest are lengthened and counted again, until the full values of the few
survivors are counted. The lower bound comes from a beam: the heaviest prefixes alone are followed
down to full values first, and the k-th of these exact counts is a count that k values do reach.

Memory: prefixes get as many more bits a round as keep about ``counters`` counters, and full values
are counted once no more are expected below the prefixes kept. At most rows / bound prefixes are ever
kept, whatever the number of distinct values; a distribution so flat that these are more than
``counters`` takes 4 more bits a round and spills. Counts are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.session import BROADCAST_ROWS, broadcast_if_small, materialize

#: Counters of a round.
COUNTERS = 1 << 22
#: Heaviest prefixes that the beam follows, per value wanted.
BEAM_PER_VALUE = 4


def first_bits(rows: int, counters: int = COUNTERS) -> int:
    """Bits of the first round: about a thousand rows a prefix, within the counters."""
    return max(1, min(int(math.log2(counters)), math.ceil(math.log2(max(2, rows))) - 10))


def next_bits(done: int, kept: int, rows: int, counters: int = COUNTERS) -> int | None:
    """Bits of the next round after ``kept`` prefixes of ``done`` bits; None for full values."""
    if done >= 64 or kept * max(1.0, rows / 2.0**done) <= counters:
        return None
    more = int(math.log2(max(1.0, counters / max(1, kept))))
    return min(64, done + max(4, more))


def _prefix(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def _counts(rows: DataFrame, kept: DataFrame | None, n_kept: int, bits_kept: int, by: Column) -> DataFrame:
    """Counts of ``by`` among rows whose prefix was kept.

    A small kept set filters the rows before they are counted; a large one (a flat distribution, where
    little can be dropped) joins the counters instead, so no hot value crosses the network unaggregated.
    """
    if kept is None:
        return rows.groupBy(by.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ids = kept.select(F.col("x").alias("p"))
    if n_kept <= BROADCAST_ROWS:
        hit = rows.withColumn("p", _prefix("h", bits_kept)).join(broadcast_if_small(ids, n_kept), "p", "left_semi")
        return hit.groupBy(by.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    counted = rows.groupBy(by.alias("x"), _prefix("h", bits_kept).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(ids, "p", "left_semi").select("x", "n")


def most_frequent(df: DataFrame, column: str, k: int, *, counters: int = COUNTERS, beam_per_value: int = BEAM_PER_VALUE) -> DataFrame:
    """The ``k`` non-null values of ``column`` with the most rows: ``value, n, rank`` (exact counts).

    Ties are broken by the value, ascending; fewer than ``k`` distinct values give all of them, an
    empty or all-null column gives no rows. The empty string is a value.
    """
    rows = df.select(F.col(column).alias("v")).filter("v IS NOT NULL").withColumn("h", F.xxhash64("v"))
    n_rows, beam = df.count(), max(1, k * beam_per_value)
    bits = first_bits(n_rows, counters)
    level = materialize(_counts(rows, None, 0, 0, _prefix("h", bits)), "prefixes")

    # Beam: full values along the heaviest prefixes; their k-th exact count bounds from below.
    top = level.orderBy(F.desc("n"), "x").limit(beam)
    followed = _counts(rows, top, beam, bits, F.col("v"))
    reached = [r[0] for r in followed.orderBy(F.desc("n")).limit(k).select("n").collect()]
    bound = reached[-1] if len(reached) == k else 1

    # Refinement: every prefix whose count reaches the bound, lengthened until full values remain.
    while True:
        kept = level.filter(F.col("n") >= bound)
        n_kept = kept.count()
        longer = next_bits(bits, n_kept, n_rows, counters)
        level = _counts(rows, kept, n_kept, bits, F.col("v") if longer is None else _prefix("h", longer))
        if longer is None:
            break
        level, bits = materialize(level.filter(F.col("n") >= bound), "prefixes"), longer
    best = level.filter(F.col("n") >= bound).orderBy(F.desc("n"), "x").limit(k)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "x"))).alias("a"))
    return ranked.select(F.posexplode("a").alias("i", "e")).select(
        F.col("e.x").alias("value"), (-F.col("e.m")).alias("n"), (F.col("i") + 1).cast("int").alias("rank")
    )
