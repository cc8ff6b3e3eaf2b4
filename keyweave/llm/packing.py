"""Filling containers of fixed token capacity by cost-balanced packing.

A sequence costs the trainer a linear part (tokens) and a quadratic part (attention inside each
document), so containers with equal tokens can differ in work. Within a shard, documents are taken
from the longest down and each goes to the container of lowest cost that still has room; a container
is added only when none has. Texts longer than a container are first cut into full containers and a
rest; nothing else is cut. Shards are made by a hash of the item, so their number grows with the
data and their size does not, and every shard is one task's work of bounded memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one shard; the larger it is, the less space its last containers leave.
SHARD_ITEMS = 8_192
#: Cost of a document of n tokens: n + ATTENTION * n * n.
ATTENTION = 1 / 2048


def assign(sizes: np.ndarray, capacity: int, attention: float = ATTENTION) -> np.ndarray:
    """Container number of each item (sizes descending, none above ``capacity``).

    Starts with as few containers as the total needs, so balancing the cost also fills them evenly.
    """
    n_start = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(len(sizes) + n_start, capacity, dtype=np.int64)
    cost = np.zeros(len(room))
    open_ = n_start
    out = np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes):
        fits = np.flatnonzero(room[:open_] >= s)
        if len(fits):
            j = fits[np.argmin(cost[fits])]
        else:
            j = open_
            open_ += 1
        room[j] -= s
        cost[j] += s + attention * float(s) * float(s)
        out[i] = j
    used = np.unique(out)
    return np.searchsorted(used, out)


def pack(
    docs: DataFrame, id_col: str, size_col: str, capacity: int, *, shard_items: int = SHARD_ITEMS, attention: float = ATTENTION
) -> DataFrame:
    """One row per piece: ``shard, bin, doc_id, piece, n_pieces, start, n_tokens``.

    ``start`` is the piece's first token within its document. A document within the capacity is one
    piece. Sizes that are null count as 0; items of size 0 are placed too. Repeated rows are items of
    their own. A null id is an id. Empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    n_items = items.select(F.coalesce(F.sum(F.greatest(F.ceil(F.col("size") / F.lit(capacity)), F.lit(1))), F.lit(0))).head()[0]
    shards = max(1, -(-int(n_items) // shard_items))
    # Full pieces fill a container alone and need no placing; the rest is placed with the others.
    n_pieces = F.greatest(F.ceil(F.col("size") / F.lit(capacity)).cast("int"), F.lit(1))
    # Repeated rows, null ids among them, are numbered so that they spread over the shards too.
    times = items.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
    pieces = (
        times.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .withColumn("n_pieces", n_pieces)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("start", F.col("piece").cast("long") * F.lit(capacity))
        .withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "piece", "time"), F.lit(shards)).cast("int"))
    )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        return pdf.assign(bin=assign(pdf.n_tokens.to_numpy(), capacity, attention)).astype({"doc_id": "Int64"})[
            ["shard", "bin", "doc_id", "piece", "n_pieces", "start", "n_tokens"]
        ]

    # A shard is much work for few bytes, so the number of tasks is not left to their size.
    spark = docs.sparkSession
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    spread = pieces.select("shard", "doc_id", "piece", "n_pieces", "start", "n_tokens").repartition(tasks, "shard")
    schema = "shard int, bin long, doc_id long, piece int, n_pieces int, start long, n_tokens long"
    return spread.groupBy("shard").applyInPandas(place, schema)


def bin_report(packed: DataFrame, capacity: int, attention: float = ATTENTION) -> DataFrame:
    """Per container: pieces, tokens, unused tokens, cost."""
    t = F.col("n_tokens")
    return packed.groupBy("shard", "bin").agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.sum(t).alias("n_tokens"),
        (F.lit(capacity) - F.sum(t)).alias("unused"),
        F.sum(t + F.lit(attention) * t * t).alias("cost"),
    )
