"""Queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.llm import frequent, mixing, packing, readability, seen, tokens
from keyweave.session import materialize, spread, table

TOP_K = 25


def p2_found(spark, d):
    return frequent.most_frequent(table(spark, d, "update_log"), "rec_key", TOP_K).select(F.col("value").alias("rec_key"))


def p2_top(spark, d):
    top = frequent.most_frequent(table(spark, d, "update_log"), "rec_key", TOP_K)
    return top.select(F.col("value").alias("rec_key"), "n", "rank")


def _seen(spark, d):
    return seen.seen_before(table(spark, d, "update_log"), "rec_key", "log_id", table(spark, d, "tiny_records"), "key_ptr")


def p4_found(spark, d):
    return _seen(spark, d).answers.filter("seen").select(F.col("id").alias("log_id"))


def p4_errors(spark, d):
    return _seen(spark, d).report


def p4_counts(spark, d):
    return _seen(spark, d).report.select("n_rows", "n_new")


def _sized(spark, d, *more):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", *more))
    return materialize(docs.select("doc_id", *more, tokens.token_count(F.col("text")).alias("n_tokens")), "sized")


def _capacity(spark, d):
    return table(spark, d, "pack_bins").agg(F.max("capacity_tokens")).head()[0]


def p6_found(spark, d):
    packed = packing.pack(_sized(spark, d), "doc_id", "n_tokens", _capacity(spark, d))
    return packed.filter("n_pieces > 1").select("doc_id").distinct()


def p6_packed(spark, d):
    return packing.pack(_sized(spark, d), "doc_id", "n_tokens", _capacity(spark, d))


def p6_bins(spark, d):
    capacity = _capacity(spark, d)
    return packing.bin_report(packing.pack(_sized(spark, d), "doc_id", "n_tokens", capacity), capacity)


def p6_checks(spark, d):
    """What must hold of a packing of all documents, counted."""
    sized, capacity = _sized(spark, d), _capacity(spark, d)
    packed = materialize(packing.pack(sized, "doc_id", "n_tokens", capacity), "packed")
    bins = packing.bin_report(packed, capacity)
    back = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("n"), F.max("n_pieces").alias("pieces"))
    docs = sized.join(back, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(~F.col("placed").eqNullSafe(F.col("n_tokens"))).alias("n_incomplete"),
        F.count_if((F.col("n_tokens") <= capacity) & (F.col("n") > 1)).alias("n_split_needlessly"),
    )
    least = F.ceil(F.sum("n_tokens") / F.lit(capacity))
    overfull = bins.agg(F.count_if(F.col("n_tokens") > capacity)).scalar()
    return docs.withColumn("n_overfull", overfull).withColumn("nearly_full", bins.agg(F.count(F.lit(1)) <= 1.02 * least + 1).scalar())


def p6_fill(spark, d):
    """Containers used and least possible, and the spread of their cost."""
    capacity = _capacity(spark, d)
    bins = packing.bin_report(packing.pack(_sized(spark, d), "doc_id", "n_tokens", capacity), capacity)
    return bins.agg(
        F.count(F.lit(1)).alias("n_bins"), F.ceil(F.sum("n_tokens") / F.lit(capacity)).alias("least_bins"), F.min("cost").alias("least_cost"),
        F.avg("cost").alias("mean_cost"), F.max("cost").alias("greatest_cost"), F.stddev_pop("cost").alias("cost_spread"),
    )


def p7_found(spark, d):
    return mixing.mix(_sized(spark, d, "source"), table(spark, d, "mix_targets")).report.filter("short").select("source")


def p7_mix(spark, d):
    return mixing.mix(_sized(spark, d, "source"), table(spark, d, "mix_targets")).rows


def p7_shares(spark, d):
    return mixing.mix(_sized(spark, d, "source"), table(spark, d, "mix_targets")).report


def p7_checks(spark, d):
    """What must hold of a mix, per target: every block in its Pfair window, repeats and amounts kept."""
    targets = table(spark, d, "mix_targets")
    out = mixing.mix(_sized(spark, d, "source"), targets)
    goal = targets.select("source", "target_share", "max_repeats").toPandas().sort_values("source")
    weights = mixing.slot_weights(goal.target_share.tolist())
    plan = spark.createDataFrame(list(zip(goal.source, weights)), "source string, w long").join(out.report, "source")
    amount = F.least("wanted", F.col("supply").cast("double"))
    rows = out.rows.join(plan.select("source", "w", F.greatest(F.floor(amount) - 1, F.lit(0)).alias("last")), "source")
    i = F.expr(f"least(pos, last) div {mixing.BLOCK_TOKENS}")
    period = F.lit(sum(weights))
    inside = (F.floor(i * period / F.col("w")) <= F.col("slot")) & (F.col("slot") < F.ceil((i + 1) * period / F.col("w")))
    held = rows.groupBy("source").agg(F.bool_and(inside).alias("inside"), F.max("n_tokens").alias("longest"))
    repeats = targets.select("source", "max_repeats")
    j = plan.join(held, "source", "left").join(repeats, "source")
    reached = (F.col("tokens") >= amount - 1) & (F.col("tokens") < amount + F.coalesce("longest", F.lit(0)) + 1)
    return j.select(
        "source", "n_docs", F.coalesce("inside", F.lit(True)).alias("in_windows"),
        (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), reached.alias("amount_reached"),
    )


def _levels(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return readability.levels(docs, readability.fit_levels(docs, table(spark, d, "reading_labels")))


def p8_found(spark, d):
    return _levels(spark, d).filter("level >= 4").select("doc_id")


def p8_levels(spark, d):
    return _levels(spark, d)


def p8_profile(spark, d):
    return readability.profile(spread(table(spark, d, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_top, p4_found, p4_errors, p4_counts, p6_found, p6_packed, p6_bins, p6_checks, p6_fill, p7_found, p7_mix, p7_shares, p7_checks, p8_found, p8_levels, p8_profile)
}

_TOP = f"""
SELECT rec_key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, rec_key) AS rank
FROM update_log WHERE rec_key IS NOT NULL GROUP BY rec_key QUALIFY rank <= {TOP_K}"""

SQL = {
    "p2_found": f"SELECT rec_key FROM ({_TOP})",
    "p2_top": f"SELECT rec_key, n, CAST(rank AS INTEGER) AS rank FROM ({_TOP})",
    "p6_checks": """SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_incomplete, CAST(0 AS BIGINT) AS n_split_needlessly,
  CAST(0 AS BIGINT) AS n_overfull, true AS nearly_full FROM documents""",
    # Sized in characters: no choice of tokenizer changes which sources fall short.
    "p7_found": r"""
WITH d AS (SELECT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS k, length(text) AS n FROM documents),
  s AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(d.n), 0) AS size FROM mix_targets t LEFT JOIN d ON d.k = t.source GROUP BY ALL)
SELECT source FROM s WHERE size * max_repeats < target_share * (SELECT sum(size) FROM s)""",
    "p7_checks": r"""
SELECT t.source, count(d.k) AS n_docs, true AS in_windows, true AS repeats_kept, true AS amount_reached FROM mix_targets t
LEFT JOIN (SELECT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g') AS k FROM documents) d ON d.k = t.source
GROUP BY t.source""",
    "p4_counts": """
SELECT count(rec_key) AS n_rows, count(DISTINCT rec_key) - (SELECT count(DISTINCT rec_key) FROM update_log
  WHERE rec_key IN (SELECT key_ptr FROM tiny_records)) AS n_new FROM update_log""",
    "p4_found": """
SELECT log_id FROM (
  SELECT log_id, rec_key, row_number() OVER (PARTITION BY rec_key ORDER BY log_id) AS rn FROM update_log WHERE rec_key IS NOT NULL)
WHERE rn > 1 OR rec_key IN (SELECT key_ptr FROM tiny_records WHERE key_ptr IS NOT NULL)""",
}
