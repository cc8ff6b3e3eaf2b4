"""Rebuilding the current state of keyed tables from a feed of inserts, updates and deletes.

Column-wise last-writer-wins, in SQL expressions only. For every record the feed is reduced in one
aggregation: for each field the value of the latest change that set it (``max_by``), the latest
replacement, the latest delete. A field counts only if its change comes after the record's latest
delete, its database's latest clear, and not before its latest replacement. Because ``max`` is
idempotent and commutative, repeated and out-of-order changes need no sort and no deduplication,
and the aggregation combines map-side, so a hot key costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.session import materialize

# Numbers of the change kinds as they appear in feeds.
OP_NUMBERS = {"0": "VOID", "1": "SET", "2": "REMOVE", "3": "CLEAR"}
#: SET replaces a record, PATCH sets only its non-null fields.
OP_NAMES = ("VOID", "SET", "REMOVE", "CLEAR", "PATCH")

_BLANKS = " \t\r\n\x0b\x0c"


def normalize_op(op: Column) -> Column:
    """Change kind in one spelling: case, outer blanks and an ``op_`` prefix do not count, enum
    numbers are names. Anything else, empty and null included, gives null."""
    bare = F.upper(F.btrim(op, F.lit(_BLANKS)))
    named = F.lit(None).cast("string")
    for name in OP_NAMES:
        spellings = [name, f"OP_{name}", *[n for n, o in OP_NUMBERS.items() if o == name]]
        named = F.when(bare.isin(*spellings), F.lit(name)).otherwise(named)
    return named


def _names(scope: Sequence[str], fields: Sequence[str]) -> tuple[list[str], list[str]]:
    return [f"s{i}" for i in range(len(scope))], [f"f{i}" for i in range(len(fields))]


def _latest(seq: str, cond: str) -> Column:
    return F.expr(f"max({seq}) FILTER (WHERE {cond})")


def _reduced(changes: DataFrame, scope: Sequence[str], key: str, seq: str, op: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(a row per record, a row per cleared database), as :func:`reduce_changes` describes them."""
    s, f = _names(scope, fields)
    plain = changes.select(
        *[F.col(c).alias(n) for c, n in zip(scope, s)],
        F.col(key).alias("k"),
        F.col(seq).cast("long").alias("q"),
        normalize_op(F.col(op)).alias("o"),
        *[F.col(c).alias(n) for c, n in zip(fields, f)],
    ).filter(F.col("q").isNotNull())
    keyed = plain.filter(F.col("k").isNotNull() & F.col("o").isin("SET", "PATCH", "REMOVE"))
    aggs = [_latest("q", "o <> 'REMOVE'").alias("w"), _latest("q", "o = 'SET'").alias("r"), _latest("q", "o = 'REMOVE'").alias("d")]
    for i, n in enumerate(f):
        sets = f"o <> 'REMOVE' AND {n} IS NOT NULL"
        aggs += [F.expr(f"max_by({n}, struct(q, {n})) FILTER (WHERE {sets})").alias(f"v{i}"), _latest("q", sets).alias(f"u{i}")]
    state = keyed.groupBy(*s, "k").agg(*aggs).withColumn("c", F.lit(None).cast("long"))
    return state, plain.filter("o = 'CLEAR'").groupBy(*s).agg(F.max("q").alias("c"))


def reduce_changes(
    changes: DataFrame, *, scope: Sequence[str], key: str, seq: str, op: str, fields: Sequence[str] = ()
) -> DataFrame:
    """Mergeable state of a feed: a row per record (``s0..., k``: latest write ``w``, replacement ``r``,
    delete ``d``, per field its latest value ``v0...`` and that one's sequence ``u0...``) and a row with
    a null key per cleared database (``c``). States of parts of a feed merge in any order."""
    records, cleared = _reduced(changes, scope, key, seq, op, fields)
    return records.unionByName(cleared, allowMissingColumns=True)


def base_state(base: DataFrame, *, scope: Sequence[str], key: str, fields: Sequence[str] = ()) -> DataFrame:
    """State of records from before a feed: written earlier than any change."""
    s, _ = _names(scope, fields)
    start = F.lit(-(2**63))
    return base.filter(F.col(key).isNotNull()).select(
        *[F.col(c).alias(n) for c, n in zip(scope, s)],
        F.col(key).alias("k"),
        start.alias("w"),
        start.alias("r"),
        F.lit(None).cast("long").alias("d"),
        *[x for i, c in enumerate(fields) for x in (F.col(c).alias(f"v{i}"), F.when(F.col(c).isNotNull(), start).alias(f"u{i}"))],
        F.lit(None).cast("long").alias("c"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state from the union of several."""
    cols = states.columns
    s = [c for c in cols if c[0] == "s"]
    aggs = [F.max(c).alias(c) for c in ("w", "r", "d")]
    for i in range(sum(c[0] == "v" for c in cols)):
        aggs += [F.expr(f"max_by(v{i}, struct(u{i}, v{i})) FILTER (WHERE u{i} IS NOT NULL)").alias(f"v{i}"), F.max(f"u{i}").alias(f"u{i}")]
    return states.groupBy(*s, "k").agg(*aggs, F.max("c").alias("c")).select(*cols)


def current_records(state: DataFrame, *, scope: Sequence[str], key: str, seq: str, fields: Sequence[str] = ()) -> DataFrame:
    """The records that exist in a state: ``scope..., key, fields..., seq``."""
    return _alive(state.filter("k IS NOT NULL"), state.filter("k IS NULL"), scope, key, seq, fields)


def _alive(records: DataFrame, cleared: DataFrame, scope: Sequence[str], key: str, seq: str, fields: Sequence[str]) -> DataFrame:
    s, _ = _names(scope, fields)
    # One row per cleared database; it is broadcast only if it measures small.
    cleared = cleared.select(*[F.col(n).alias(f"c{n}") for n in s], F.col("c").alias("cleared_at"))
    records = records.drop("c")
    if s:
        on = F.lit(True)
        for n in s:
            on = on & records[n].eqNullSafe(cleared[f"c{n}"])
        records = records.join(cleared, on, "left")
    else:
        records = records.withColumn("cleared_at", cleared.select(F.max("cleared_at")).scalar())
    barrier = F.greatest("d", "cleared_at")
    alive = records.filter(F.col("w").isNotNull() & (barrier.isNull() | (F.col("w") > barrier)))
    values = [
        F.when(
            (barrier.isNull() | (F.col(f"u{i}") > barrier)) & (F.col("r").isNull() | (F.col(f"u{i}") >= F.col("r"))),
            F.col(f"v{i}"),
        ).alias(c)
        for i, c in enumerate(fields)
    ]
    return alive.select(
        *[F.col(n).alias(c) for n, c in zip(s, scope)],
        F.col("k").alias(key),
        *values,
        F.when(F.col("w") > F.lit(-(2**63)), F.col("w")).alias(seq),
    )


def apply_changes(
    changes: DataFrame,
    *,
    scope: Sequence[str],
    key: str,
    seq: str,
    op: str,
    fields: Sequence[str] = (),
    base: DataFrame | None = None,
) -> DataFrame:
    """State of all records after the feed: ``scope..., key, fields..., seq``.

    ``scope`` names a database (CLEAR removes all records of one), ``seq`` is the true order inside
    a scope. ``base`` (``scope..., key, fields...``) holds records from before the feed; they get a
    null ``seq``. ``seq`` of the result is that of the latest change that wrote the record.

    Defined cases: rows with a null ``seq``, an unknown or null ``op``, or SET/PATCH/REMOVE without
    a key change nothing; a null scope column is a database of its own; a field that the last
    replacement left null is null; of several changes with equal ``seq`` on one record a delete or
    clear wins, and among values the greatest. An empty feed returns ``base`` (or nothing). Columns
    not named here are ignored, whatever they are called.
    """
    records, cleared = _reduced(changes, scope, key, seq, op, fields)
    if base is not None:
        records = merge_states(records.unionByName(base_state(base, scope=scope, key=key, fields=fields)))
    if scope:
        # Written first, so that its size is known when the join is planned: a small one never makes
        # the records move again.
        cleared = materialize(cleared, "cleared")
    return _alive(records, cleared, scope, key, seq, fields)
