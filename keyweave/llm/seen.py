"""Has this key been seen before? Filter, then verify.

:class:`SeenKeys` keeps on shared storage, in one table of versions, the full keys seen so far and a
blocked Bloom filter over them: a word of 64 bits per few keys, in which each key sets a few bits. The
filter is built once and grows by the words of new keys; words and keys are added in the same commit.

A batch is answered in three steps. Its rows are reduced, map-side first, to the first arrival of each
key; all later rows have been seen, and their keys go no further. First arrivals are tested against the
filter by integer operations inside the join to its words, which runs map-side while these measure small:
a negative is certainly new and is answered at once. Only positives are shuffled to the full keys on disk
for an exact lookup. A positive whose key is not there was wrong; each is logged, so the filter's error is
measured, not estimated, and no answer is wrong.
"""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.session import kept_path, materialize
from keyweave.sources.versioned import VersionedTable

#: Share of new keys that the filter may take for seen ones; with the keys expected it sets the filter's size.
TARGET_ERROR = 1 / 256
#: Bits that a key sets in its word.
KEY_BITS = 5
#: Stored rows: a key (null in rows of the filter), or a word of the filter (null in rows of keys).
STORED = "word long, k string, bits long"


class Seen(NamedTuple):
    """``answers``: id, seen; ``disproved``: id, key of each wrong positive; ``report``: one row."""

    answers: DataFrame
    disproved: DataFrame
    report: DataFrame


def word_error(load: float, key_bits: int = KEY_BITS) -> float:
    """Share of new keys that meet all their bits set in words of ``load`` keys on average."""
    miss, p = 0.0, math.exp(-load)
    for n in range(1, 200):
        p *= load / n
        miss += p * (1 - (63 / 64) ** (key_bits * n)) ** key_bits
    return miss


def filter_words(expected: int, target_error: float = TARGET_ERROR) -> int:
    """Words of a filter that errs on the target share of new keys once it holds ``expected`` keys."""
    lo, hi = 1e-3, 64.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if word_error(mid) < target_error else (lo, mid)
    return max(1, math.ceil(expected / lo))


def _word(k: str, words: int) -> Column:
    return F.pmod(F.xxhash64(k), F.lit(words).cast("long"))


def _mask(k: str) -> Column:
    """The bits of a key in its word, from a second hash, six bits of it for each."""
    h = F.xxhash64(F.lit(1), k)
    one = F.lit(1).cast("long")
    out = F.lit(0).cast("long")
    for i in range(KEY_BITS):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", one, at))
    return out


class SeenKeys:
    """The keys seen so far, under ``path``; ``expected`` keys set the size of a new filter. More keys
    than expected only raise the share of positives that have to be looked up."""

    def __init__(self, spark: SparkSession, path: str, expected: int = 1 << 20, target_error: float = TARGET_ERROR) -> None:
        self.store = VersionedTable(spark, path, STORED, ordered_by=["word"])
        words = self.store.properties().get("words")
        self.words = int(words) if words else filter_words(expected, target_error)

    def _added(self, keys: DataFrame) -> DataFrame:
        """Rows to store for distinct new keys (``k``): the keys, and the filter's words with their bits."""
        placed = keys.select(_word("k", self.words).alias("word"), "k", _mask("k").alias("bits"))
        bits = placed.groupBy("word").agg(F.bit_or("bits").alias("bits"))
        return placed.select("word", "k", F.lit(None).cast("long").alias("bits")).unionByName(bits.select("word", F.lit(None).cast("string").alias("k"), "bits"))

    def filter(self) -> DataFrame:
        """``word, bits``: the words of all commits put together."""
        return self.store.read().filter("k IS NULL").groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def keys(self) -> DataFrame:
        return self.store.read().filter("k IS NOT NULL").select("k")

    def add_history(self, keys: DataFrame, key: str) -> None:
        """Take in keys from before; nulls are left out, and keys held already change nothing."""
        new = keys.select(F.col(key).alias("k")).filter("k IS NOT NULL").distinct()
        if self.store.version():
            new = new.join(self.keys(), "k", "left_anti")
        self.store.commit(added=self._added(materialize(new, "history")), properties={"words": str(self.words)})

    def answer(self, rows: DataFrame, key: str, order: str, remember: bool = True) -> Seen:
        """For each row with a non-null key: is the key held, or did it occur in a row before it?

        ``order`` is unique and gives the order of arrival. Null keys have no answer and are left out;
        the empty string is a key. Rows with a null order are left out. Empty tables are fine. The keys
        that are new are added in one commit, unless not to ``remember``.
        """
        q = rows.select(F.col(order).cast("long").alias("id"), F.col(key).alias("k")).filter("k IS NOT NULL AND id IS NOT NULL")
        firsts = q.groupBy("k").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        words = self.filter()
        hit = F.coalesce(F.col("bits").bitwiseAND(_mask("k")) == _mask("k"), F.lit(False))
        tested = firsts.withColumn("word", _word("k", self.words)).join(words, "word", "left").select("id", "k", "n", hit.alias("positive"))
        tested = materialize(tested, "tested")
        positives = tested.filter("positive").select("id", "k")
        # The fewer positives are the side that can be broadcast; the keys on disk then stay where they are.
        found = self.keys().join(positives, "k", "left_semi")
        disproved = materialize(positives.join(found, "k", "left_anti").select("id", F.col("k").alias("key")), "disproved")
        negatives = tested.filter("NOT positive").select("id", "k")
        new = negatives.unionByName(disproved.withColumnRenamed("key", "k"))
        # Only ids travel here: a row is new if it is the first arrival of a new key.
        fresh = new.select("id", F.lit(True).alias("fresh"))
        answers = q.select("id").join(fresh, "id", "left").select("id", F.col("fresh").isNull().alias("seen"))
        counts = tested.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(~F.col("positive")).alias("n_negative"), F.count_if("positive").alias("n_verified"))
        n_wrong = F.coalesce(disproved.select(F.count(F.lit(1))).scalar(), F.lit(0))
        report = counts.withColumn("n_disproved", n_wrong)
        n_new = F.col("n_negative") + F.col("n_disproved")
        report = report.select(
            "n_rows", n_new.alias("n_new"), "n_verified", "n_disproved", F.try_divide("n_disproved", n_new).alias("filter_error"), F.lit(self.words).alias("filter_words")
        )
        if remember:
            self.store.commit(added=self._added(new.select("k")), properties={"words": str(self.words)})
        return Seen(answers, disproved, report)


def seen_before(
    rows: DataFrame, key: str, order: str, history: DataFrame, history_key: str, *, path: str | None = None, target_error: float = TARGET_ERROR
) -> Seen:
    """One batch against a history that is taken in first; see :meth:`SeenKeys.answer`. Without ``path``
    the keys of this batch are not remembered."""
    spark = rows.sparkSession
    expected = history.select(F.approx_count_distinct(history_key)).head()[0]
    held = SeenKeys(spark, path or kept_path(spark, "seen", uuid.uuid4().hex), max(1, expected), target_error)
    held.add_history(history, history_key)
    return held.answer(rows, key, order, remember=path is not None)
