"""Change batches applied to a stored table."""

import random

import pytest
from test_changefeed import SCHEMA, replay

from keyweave.streaming.apply import AppliedTable

COLUMNS = "server int, db int, k string, a string, b string"


def make(spark, path):
    return AppliedTable(spark, path, COLUMNS, scope=["server", "db"], key="k", seq="seq", op="op", fields=["a", "b"])


def feed(seed, n=120):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, "", "x", "yy"])
    ops = ["SET", "PATCH", "REMOVE", "CLEAR", "VOID"]
    changes = [(1, rnd.choice([0, None]), rnd.choice(["hot", "b", "c"]), q, rnd.choices(ops, [6, 6, 3, 0.3, 0.5])[0], value(), value(), None) for q in range(n)]
    changes += rnd.choices(changes, k=n // 4)
    rnd.shuffle(changes)
    return changes


def state(t):
    return sorted((tuple(r) for r in t.records().collect()), key=str)


def test_batches_in_any_order(spark, tmp_path):
    changes, t = feed(1), make(spark, f"file://{tmp_path}/t")
    for number, at in enumerate(range(0, len(changes), 60)):
        batch = spark.createDataFrame(changes[at : at + 60], SCHEMA)
        assert t.apply(batch, number)
        assert not t.apply(batch, number)
        assert state(t) == replay(changes[: at + 60])
    assert t.store.version() == 3


def test_a_failed_batch_has_no_effect(spark, tmp_path, monkeypatch):
    changes, t = feed(2, 40), make(spark, f"file://{tmp_path}/t")
    t.apply(spark.createDataFrame(changes[:25], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(t.store, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.apply(spark.createDataFrame(changes[25:], SCHEMA), 1)
    assert state(t) == replay(changes[:25])
    assert t.apply(spark.createDataFrame(changes[25:], SCHEMA), 1) and state(t) == replay(changes)


def test_stream(spark, tmp_path):
    changes, t = feed(3, 60), make(spark, f"file://{tmp_path}/t")
    for part in (changes[:30], changes[30:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        t.poll(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/src"), f"{tmp_path}/cp").awaitTermination()
    assert state(t) == replay(changes)
