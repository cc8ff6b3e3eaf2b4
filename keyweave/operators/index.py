"""Secondary and inverted indices: distinct (index key, primary key) pairs.

An index is a frame ``ikey, pkey``. Lists of a hot index key are never collected: they stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.model import NO_WORD, sort_keys

IKEY, PKEY = "ikey", "pkey"


def build(table: DataFrame, index_key: Column | str, primary_key: Column | str) -> DataFrame:
    """Pairs of a table; rows with a null index key are not indexed."""
    ik = F.col(index_key) if isinstance(index_key, str) else index_key
    pk = F.col(primary_key) if isinstance(primary_key, str) else primary_key
    return table.select(ik.alias(IKEY), pk.alias(PKEY)).filter(F.col(IKEY).isNotNull()).distinct()


def add(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Idempotent."""
    return index.select(IKEY, PKEY).unionByName(pairs.select(IKEY, PKEY).filter(F.col(IKEY).isNotNull())).distinct()


def remove(index: DataFrame, pairs: DataFrame) -> DataFrame:
    gone = pairs.select(F.col(IKEY).alias("i"), F.col(PKEY).alias("p"))
    return index.join(gone, index[IKEY].eqNullSafe(gone.i) & index[PKEY].eqNullSafe(gone.p), "left_anti")


def check(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ikey, pkey, found`` for each distinct pair asked for."""
    has = index.select(F.col(IKEY).alias("i"), F.col(PKEY).alias("p")).distinct().withColumn("hit", F.lit(True))
    asked = pairs.select(IKEY, PKEY).distinct()
    j = asked.join(has, asked[IKEY].eqNullSafe(has.i) & asked[PKEY].eqNullSafe(has.p), "left")
    return j.select(IKEY, PKEY, F.coalesce("hit", F.lit(False)).alias("found"))


def get_values(index: DataFrame, key, max_values: int = 0) -> DataFrame:
    """Primary keys of an index key in their order; 0 is all."""
    found = index.filter(F.col(IKEY) == F.lit(key)).select(PKEY).orderBy(PKEY)
    return found.limit(max_values) if max_values else found


def get_values_multi(index: DataFrame, keys: DataFrame, max_values: int = 0) -> DataFrame:
    """``ikey, pkey, rank`` for many index keys; the limit per key is applied before the shuffle's end
    (Spark's window group limit), so hot keys send ``max_values`` rows per task."""
    found = index.join(keys.select(IKEY).distinct(), IKEY, "left_semi")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(IKEY).orderBy(PKEY)))
    return ranked.filter(F.col("rank") <= max_values) if max_values else ranked


def jump(index: DataFrame, key, value, n: int, order: str = "lexical") -> DataFrame:
    """The first ``n`` pairs not below (key, value), in pair order."""
    k, v = sort_keys(order, F.col(IKEY)), F.col(PKEY)
    lo = sort_keys(order, F.lit(key))
    same = F.lit(True)
    above = F.lit(False)
    for a, b in zip(k, lo):
        above = above | (same & (a > b))
        same = same & (a == b)
    return index.filter(above | (same & (v >= F.lit(value)))).orderBy(*k, v).limit(n)


def join_primary(index: DataFrame, table: DataFrame, primary_key: str, keys: DataFrame | None = None) -> DataFrame:
    """Records behind the index, optionally of some index keys only: ``ikey`` and the table's columns."""
    wanted = index if keys is None else index.join(keys.select(IKEY).distinct(), IKEY, "left_semi")
    pairs, rows = wanted.select(F.col(IKEY).alias("__i"), F.col(PKEY).alias("__p")).alias("x"), table.alias("t")
    found = pairs.join(rows, F.col("x.__p") == F.col(f"t.`{primary_key}`"))
    return found.select(F.col("x.__i").alias(IKEY), *[F.col(f"t.`{c}`") for c in table.columns])


def refresh(index: DataFrame, before: DataFrame, after: DataFrame, index_key: str, primary_key: str) -> DataFrame:
    """Index of the changed table: pairs of changed records go, the new ones come; pairs of unchanged
    records are not touched."""
    old, new = build(before, index_key, primary_key), build(after, index_key, primary_key)
    return add(remove(index, old.exceptAll(new)), new.exceptAll(old))


def build_inverted(docs: DataFrame, text: str, doc_id: str, pattern: str = NO_WORD) -> DataFrame:
    """Pairs of lower-cased word and document; words are letters, marks and digits of any script."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(text), pattern))).alias("w"), F.col(doc_id).alias("d"))
    return build(words.filter("w <> ''"), "w", "d")


def search_all(index: DataFrame, words: list[str]) -> DataFrame:
    """Documents that hold every word: postings are counted per document, not intersected as lists."""
    wanted = list(dict.fromkeys(w.lower() for w in words))
    hits = index.filter(F.col(IKEY).isin(wanted)).groupBy(PKEY).agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") == len(wanted)).select(PKEY)


def search_any(index: DataFrame, words: list[str]) -> DataFrame:
    return index.filter(F.col(IKEY).isin([w.lower() for w in words])).select(PKEY).distinct()
