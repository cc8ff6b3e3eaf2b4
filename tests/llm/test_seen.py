"""Seen-before answers against a set that keeps all keys."""

import random

import oracle
import pytest

from keyweave.llm.seen import SeenKeys, filter_words, seen_before, word_error


def run(spark, rows, history, **kw):
    r = spark.createDataFrame(rows, "log_id long, key string, id string, k string")
    h = spark.createDataFrame([(x, "e") for x in history], "old string, id string")
    return seen_before(r, "key", "log_id", h, "old", **kw)


@pytest.mark.parametrize("target", [1 / 256, 0.5, 0.97])
def test_against_set(spark, target):
    rnd = random.Random(5)
    keys = ["hot"] * 300 + [f"k{rnd.randrange(500)}" for _ in range(600)] + [None] * 20 + ["", "", "y" * 9000]
    rnd.shuffle(keys)
    rows = [(i * 3, k, "clash", None) for i, k in enumerate(keys)]
    history = [f"k{i}" for i in range(0, 500, 7)] * 2 + [None]
    want, held = {}, {h for h in history if h is not None}
    for i, k, *_ in rows:
        if k is not None:
            want[i] = k in held
            held.add(k)
    rnd.shuffle(rows)
    out = run(spark, rows, history, target_error=target)
    assert {r.id: r.seen for r in out.answers.collect()} == want
    report, wrong = out.report.head(), out.disproved.collect()
    assert report.n_rows == len(want) and report.n_new == sum(not s for s in want.values())
    assert report.n_disproved == len(wrong) and all(not want[r.id] for r in wrong)
    assert report.filter_error == pytest.approx(len(wrong) / report.n_new)
    if target > 0.9:
        assert len(wrong) > 20  # a filter this small errs, and every error is found


def test_empty(spark):
    out = run(spark, [], ["a"])
    assert out.answers.collect() == [] and out.report.head().n_rows == 0 and out.report.head().filter_error is None
    assert [r.seen for r in run(spark, [(1, "a", None, None)], []).answers.collect()] == [False]


def test_filter_size():
    assert word_error(0.001) < 0.001 < word_error(3.0) < word_error(30.0) <= 1
    assert 2 < filter_words(10**6) / filter_words(5 * 10**5) + 0.01 < 2.1 and filter_words(0) == 1
    assert word_error(10**6 / filter_words(10**6)) == pytest.approx(1 / 256, rel=0.01)


def test_the_measured_error_is_near_the_target(spark):
    history = spark.range(20_000).selectExpr("concat('old', id) as k")
    rows = spark.range(20_000).selectExpr("id", "concat('new', id) as k")
    report = seen_before(rows, "k", "id", history, "k", target_error=1 / 64).report.head()
    assert 0.4 / 64 < report.filter_error < 2.5 / 64 and report.n_new == 20_000


def test_batches_answer_as_one(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, "hot", f"k{rnd.randrange(80)}"]), "x", None) for i in range(400)]
    schema = "log_id long, key string, id string, k string"
    held = SeenKeys(spark, f"file://{tmp_path}/keys", 10, 0.5)
    held.add_history(spark.createDataFrame([("k1",), ("k1",), (None,)], "old string"), "old")
    got = {}
    for at in range(0, 400, 150):
        batch = rows[at : at + 150]
        rnd.shuffle(batch)
        got |= {r.id: r.seen for r in held.answer(spark.createDataFrame(batch, schema), "key", "log_id").answers.collect()}
    before, want = {"k1"}, {}
    for i, k, *_ in sorted(rows):
        if k is not None:
            want[i] = k in before
            before.add(k)
    assert got == want and {r.k for r in held.keys().collect()} == before
    again = SeenKeys(spark, f"file://{tmp_path}/keys", 10**6)
    assert again.words == held.words and again.store.version() == 4


def test_a_failed_batch_leaves_no_keys(spark, tmp_path, monkeypatch):
    held = SeenKeys(spark, f"file://{tmp_path}/keys", 10)
    held.add_history(spark.createDataFrame([("a",)], "old string"), "old")
    batch = spark.createDataFrame([(1, "b"), (2, "b"), (3, "a")], "id long, k string")
    with monkeypatch.context() as m:
        m.setattr(held.store, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            held.answer(batch, "k", "id")
    assert {r.id: r.seen for r in held.answer(batch, "k", "id").answers.collect()} == {1: False, 2: True, 3: True}


@pytest.mark.parametrize("name", ["p4_found", "p4_counts"])
def test_sql(spark, sf, name):
    assert oracle.check(spark, name, sf) > 0
