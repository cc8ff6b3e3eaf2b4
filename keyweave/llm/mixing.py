"""Mixing sources to target weights by Pfair scheduling.

Every source is a stream of its documents in a fixed random order, repeated as often as its share of
the mix needs and its repeat limit allows, and cut into blocks of equal tokens. The i-th block of a
source with target weight w may not start before slot floor(i / w) and must be done by slot
ceil((i + 1) / w); taking the released block with the earliest deadline keeps every source within
less than one block of its weight after every slot. A source that runs short leaves its later slots
idle and moves no other.

Weights are integers over a common period, after which all sources are at their weights exactly; the
schedule of one period is computed once, repeats for ever, and has at most ``resolution`` entries
whatever the size of the mix. Positions inside the streams are exact prefix sums over hash buckets,
so one source may hold most documents without its order being one task's work.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.session import materialize

#: Tokens of a block.
BLOCK_TOKENS = 16_384
#: Slots of a period at most: target shares are taken to one part in so many.
RESOLUTION = 100_000
#: Documents per bucket of the prefix sums, and the most sources a mix may name.
BUCKET_ROWS, MAX_SOURCES = 50_000, 10_000


class Mix(NamedTuple):
    """``rows``: slot, pos, source, doc_id, copy, n_tokens; ``report``: one row per target source."""

    rows: DataFrame
    report: DataFrame


def source_key(source: Column) -> Column:
    """One spelling of a source's name: case, outer blanks and the kind of separator do not count."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s_\-]+", "_")


def slot_weights(shares: list[float], resolution: int = RESOLUTION) -> list[int]:
    """Slots of each source in a period: whole numbers in the ratio of the shares, which are rounded to
    ``resolution`` parts (largest remainders first, a positive share has one at least) and reduced."""
    total = sum(shares)
    if total <= 0:
        return [0] * len(shares)
    exact = [max(0.0, x) / total * resolution for x in shares]
    parts = [max(math.floor(x + 1e-6), int(x > 0)) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: (parts[i] - exact[i], i))[: max(0, resolution - sum(parts))]:
        parts[i] += exact[i] > 0
    common = math.gcd(*parts)
    return [p // common for p in parts]


def pfair_slots(blocks: list[int]) -> list[list[int]]:
    """Slot of each block of each source, by earliest deadline first among released blocks."""
    total = sum(blocks)
    slots: list[list[int]] = [[] for _ in blocks]
    waiting = [(0, s) for s, b in enumerate(blocks) if b]
    ready: list[tuple[int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // blocks[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        if len(slots[s]) < blocks[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // blocks[s], s))
    return slots


def _streams(docs: DataFrame, n_docs: int, bucket_rows: int) -> DataFrame:
    """``docs`` (k, doc_id, n_tokens) with ``start``: tokens before the document in its source's order.
    Repeated rows stand next to each other; they are placed as one row and then numbered."""
    bits = max(0, (max(1, n_docs) // bucket_rows).bit_length())
    h = F.xxhash64("doc_id", "n_tokens", F.lit("order"))
    once = docs.groupBy("k", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("times"))
    placed = once.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    size = F.col("n_tokens") * F.col("times")
    sums = placed.groupBy("k", "bucket").agg(F.sum(size).alias("t"))
    w = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("k", "bucket", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("k", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.join(offsets, ["k", "bucket"]).withColumn("first", F.col("offset") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    each = first.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return each.select("k", "doc_id", "n_tokens", (F.col("first") + F.col("i") * F.col("n_tokens")).alias("start"))


def mix(
    docs: DataFrame,
    targets: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "n_tokens",
    block_tokens: int = BLOCK_TOKENS,
    resolution: int = RESOLUTION,
    bucket_rows: int = BUCKET_ROWS,
) -> Mix:
    """Mix ``docs`` to ``targets`` (source, target_share, max_repeats).

    The size aimed at is that of all documents of the target sources. A source supplies at most its
    size times ``max_repeats``; with less than its share it gives all it has, is reported ``short``,
    and the others keep their amounts. Documents of other or null sources take no part; null sizes are
    0; a target without documents, with a null or zero share, or no repeats, gives nothing and is
    still reported. Slots in which a source has nothing left stay idle. Repeated rows are documents of their own. The last document of a source may run
    over its amount, by less than its own length.
    """
    spark = docs.sparkSession
    named = targets.select("source", source_key(F.col("source")).alias("k"), "target_share", "max_repeats").filter("k IS NOT NULL")
    goal = named.limit(MAX_SOURCES + 1).toPandas()
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if goal.k.duplicated().any():
        raise ValueError("a source is named twice")
    mine = docs.select(
        source_key(F.col(source_col)).alias("k"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n_tokens")
    ).filter(F.col("k").isin(goal.k.tolist()))
    have = mine.groupBy("k").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("size")).toPandas()
    goal = goal.merge(have, on="k", how="left").fillna({"n_docs": 0, "size": 0, "target_share": 0.0, "max_repeats": 0})
    goal = goal.sort_values("k").reset_index(drop=True).astype({"n_docs": "int64", "size": "int64", "max_repeats": "int64"})
    total = int(goal["size"].sum())
    goal["wanted"] = goal.target_share * total
    goal["supply"] = goal["size"] * goal.max_repeats
    goal["short"] = goal.supply < goal.wanted
    goal["planned"] = [min(int(w), int(s)) for w, s in zip(goal.wanted, goal.supply)]
    weights = slot_weights(goal.target_share.tolist(), resolution)
    slots = pfair_slots(weights)
    schedule = pd.DataFrame(
        [(k, i, t, len(own)) for k, own in zip(goal.k, slots) for i, t in enumerate(own)], columns=["k", "turn", "at", "turns"]
    ).astype({"k": "object", "turn": "int64", "at": "int64", "turns": "int64"})
    schedule = spark.createDataFrame(schedule, "k string, turn long, at long, turns long")
    plan = spark.createDataFrame(
        goal[["k", "source", "target_share", "max_repeats", "n_docs", "size", "wanted", "supply", "planned", "short"]],
        "k string, source string, target_share double, max_repeats long, n_docs long, size long, wanted double, supply long, planned long, short boolean",
    )
    one = plan.filter("size > 0").select("k", F.col("source").alias("name"), F.col("size").alias("s"), F.expr("planned div size").alias("full"), F.expr("planned % size").alias("rest"))
    streams = _streams(mine, int(goal.n_docs.sum()), bucket_rows).join(F.broadcast(one), "k")  # at most MAX_SOURCES rows
    copies = streams.withColumn("uses", F.col("full") + F.when(F.col("start") < F.col("rest"), 1).otherwise(0)).filter("uses > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    # A document without tokens at the very end starts where the last block ends; it stays in that block.
    turns = spark.createDataFrame([(k, n) for k, n in zip(goal.k, weights) if n], "k string, turns_of long")
    stops = plan.select("k", F.greatest(F.col("planned") - 1, F.lit(0)).alias("last")).join(turns, "k")
    pos = F.col("copy") * F.col("s") + F.col("start")
    placed = copies.join(F.broadcast(stops), "k").withColumn("pos", pos).withColumn("block", F.expr(f"least(pos, last) div {block_tokens}"))
    placed = placed.withColumn("turn", F.col("block") % F.col("turns_of"))
    slot = F.expr(f"block div turns * {sum(weights)} + at")
    rows = placed.join(schedule, ["k", "turn"]).select(slot.alias("slot"), "pos", F.col("name").alias("source"), "doc_id", "copy", "n_tokens")
    rows = materialize(rows, "mix")
    used = rows.groupBy(F.col("source").alias("name")).agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"), (F.max("copy") + 1).alias("most_repeats")
    )
    report = plan.join(used, plan.source == used.name, "left").select(
        "source",
        "target_share",
        F.try_divide(F.coalesce("tokens", F.lit(0)), F.sum("tokens").over(Window.partitionBy())).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "n_docs",
        "size",
        "supply",
        "wanted",
        "short",
    )
    return Mix(rows, report)
