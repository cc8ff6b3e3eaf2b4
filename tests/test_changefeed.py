"""The change feed operator against a row-by-row replay."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from keyweave.operators.changefeed import apply_changes, normalize_op

SCHEMA = "server int, db int, k string, seq long, op string, a string, b string, seq_1 string"


def replay(changes, base=()):
    """Apply every distinct change in order, as its server did."""
    state = {(s, d, k): {"a": a, "b": b, "q": None} for s, d, k, a, b in base}
    for s, d, k, q, op, a, b, _ in sorted(set(changes), key=lambda c: c[3]):
        if op == "CLEAR":
            state = {x: v for x, v in state.items() if x[:2] != (s, d)}
        elif k is None:
            continue
        elif op == "REMOVE":
            state.pop((s, d, k), None)
        elif op == "SET":
            state[s, d, k] = {"a": a, "b": b, "q": q}
        elif op == "PATCH":
            old = state.get((s, d, k), {"a": None, "b": None})
            state[s, d, k] = {"a": old["a"] if a is None else a, "b": old["b"] if b is None else b, "q": q}
    return sorted(((*x, v["a"], v["b"], v["q"]) for x, v in state.items()), key=str)


def run(spark, changes, base=()):
    df = spark.createDataFrame(changes, SCHEMA)
    old = spark.createDataFrame(list(base), "server int, db int, k string, a string, b string") if base else None
    got = apply_changes(df, scope=["server", "db"], key="k", seq="seq", op="op", fields=["a", "b"], base=old)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_feed(spark, seed):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, "", "x", "yy", "ä" * 3, "z" * 5000])
    changes = []
    for q in range(400):
        op = rnd.choices(["SET", "PATCH", "REMOVE", "CLEAR", "VOID", None], [6, 6, 3, 0.1, 0.5, 0.5])[0]
        key = rnd.choices(["hot", "b", "c", None], [6, 1, 1, 0.5])[0]
        changes.append((1, rnd.choice([0, 1, None]), key, q, op, value(), value(), "clash"))
    changes += rnd.choices(changes, k=100)
    rnd.shuffle(changes)
    base = [(1, 0, "hot", "old", None), (1, 0, "kept", "k", "k"), (1, 1, "b", None, "old")]
    assert run(spark, changes) == replay(changes)
    assert run(spark, changes, base) == replay(changes, base)


def test_empty_feed(spark):
    assert run(spark, []) == []
    assert run(spark, [], [(1, 0, "x", "a", None)]) == [(1, 0, "x", "a", None, None)]


def test_null_seq_changes_nothing(spark):
    assert run(spark, [(1, 0, "x", None, "SET", "a", "b", None)]) == []


def test_op_spellings(spark):
    said = ["SET", " set", "op_set", "OP_SET", "1", "rEMOVE ", "2", "op_clear", "3", "0", "void", "", None, "4", "OP_", "\tset\n"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "x string").select(normalize_op(F.col("x"))).collect()]
    assert got == ["SET"] * 5 + ["REMOVE"] * 2 + ["CLEAR"] * 2 + ["VOID"] * 2 + [None] * 4 + ["SET"]


@pytest.mark.parametrize("name", ["p1_found", "p1_state"])
def test_sql(spark, sf, name):
    assert oracle.check(spark, name, sf) > 0
