"""Readers' unread messages against a plain scan per reader."""

import random

import oracle
import pytest

from keyweave.operators.incremental import message_store, take_in, unread_messages

RUNS = "run_id long, reader_id long, queue_prefix string, run_no int, attempt int, run_status string, min_timestamp long, file_id_ long, file_offset_ long, ts string"
MESSAGES = "msg_id long, queue_prefix string, file_id long, file_offset long, timestamp_ms long, message binary, reader_id string"


def brute(messages, runs):
    out = set()
    for reader in {r[1] for r in runs if r[1] is not None}:
        mine = [r for r in runs if r[1] == reader]
        good = [r for r in mine if r[5] is not None and r[5].strip().lower() == "ok" and r[7] is not None]
        f, o = max((r[3], r[4], r[7], r[8]) for r in good)[2:] if good else (-1, -1)
        for m in messages:
            if m[1] == mine[0][2] and m[4] is not None and m[4] >= (mine[0][6] or 0) and m[3] is not None and (m[2], m[3]) >= (f, o):
                out.add((reader, m[2], m[3]))
    return out


@pytest.fixture
def folder(spark, tmp_path):
    """(add some messages as one more file, the folder)."""

    def add(messages):
        spark.createDataFrame(messages, MESSAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

    return add, f"file://{tmp_path}/log"


def make(seed):
    rnd = random.Random(seed)
    messages, n = [], 0
    for q in ("a", "b"):
        t = 0
        for f in range(4):
            for o in sorted(rnd.sample(range(32, 900), 30)):
                t += rnd.choice([0, 5])
                n += 1
                messages.append((n, q, f, o, t, rnd.choice([None, b"", b"x"]), "clash"))
    messages += [(n + i, *m[1:]) for i, m in enumerate(rnd.choices(messages, k=40))]
    messages += [(0, None, 1, 32, 5, None, None), (0, "a", 1, None, 5, None, None), (0, "a", 9, 9, None, None, None)]
    rnd.shuffle(messages)
    runs = []
    for reader in range(12):
        q, t = rnd.choice("aab"), rnd.choice([0, 100, 10**6])
        for no in range(rnd.randrange(1, 5)):
            status = rnd.choice(["ok", " OK ", "Ok", "failed", None, "not ok"])
            pos = rnd.choice(messages) if status and status.strip().lower() == "ok" else (0, 0, None, None)
            f, o = (pos[2], pos[3]) if pos[2] is not None and pos[3] is not None else (None, None)
            runs.append((len(runs), reader, q, no, rnd.randrange(3), status, t, f, o + rnd.choice([0, 1]) if o is not None else None, None))
    return messages, runs + rnd.choices(runs, k=10)


def unread(spark, store, runs):
    got = [tuple(r)[:3] for r in unread_messages(store, spark.createDataFrame(runs, RUNS)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_each_run_reads_new_files_only(spark, tmp_path, folder):
    add, log = folder
    messages, runs = make(1)
    store = message_store(spark, f"file://{tmp_path}/store")
    parts = [messages[:150], messages[130:220], messages[220:]]
    seen = set()
    for i, part in enumerate(parts):
        add(part)
        files = set(take_in(store, log).inputFiles())
        assert len(files) == 1 and not files & seen
        seen |= files
        assert take_in(store, log) is None and store.version() == i + 1
        so_far = [m for p in parts[: i + 1] for m in p]
        assert unread(spark, store, runs) == brute(so_far, runs)
    # A file that is removed takes along the messages that no other file holds.
    gone = sorted((tmp_path / "log").glob("*.parquet"), key=lambda p: p.stat().st_mtime)[0]
    gone.unlink()
    assert take_in(store, log) is None and store.version() == 4
    assert unread(spark, store, runs) == brute(parts[1] + parts[2], runs)
    assert unread_messages(store, spark.createDataFrame(runs, RUNS), 3).count() == len(brute(messages, runs))


def test_a_failed_run_has_no_effect(spark, tmp_path, folder, monkeypatch):
    add, log = folder
    messages, runs = make(2)
    store = message_store(spark, f"file://{tmp_path}/store")
    add(messages)
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            take_in(store, log)
    assert store.version() == 0 and unread(spark, store, runs) == set()
    take_in(store, log)
    assert unread(spark, store, runs) == brute(messages, runs)


def test_processed_files_are_not_read(spark, tmp_path, folder):
    add, log = folder
    store = message_store(spark, f"file://{tmp_path}/store")
    for f in range(3):
        add([(o, "a", f, o, 10 * f, None, None) for o in range(50)])
        take_in(store, log)
    runs = spark.createDataFrame([(1, 1, "a", 1, 1, "ok", 0, 1, 40, None)], RUNS)
    data = lambda df: [f for f in df.inputFiles() if "/data/" in f]
    assert len(data(unread_messages(store, runs))) == 2
    late = spark.createDataFrame([(1, 1, "a", 1, 1, "ok", 15, 1, 40, None)], RUNS)
    assert len(data(unread_messages(store, late))) == 1


def test_empty(spark, tmp_path, folder):
    add, log = folder
    add([])
    store = message_store(spark, f"file://{tmp_path}/store")
    runs = spark.createDataFrame([], RUNS)
    assert unread_messages(store, runs).collect() == []
    take_in(store, log)
    assert unread_messages(store, runs).collect() == []
    assert unread_messages(store, spark.createDataFrame([(1, 1, "a", 1, 1, None, None, None, None, None)], RUNS)).collect() == []


@pytest.mark.parametrize("name", ["p3_found", "p3_backlog"])
def test_sql(spark, sf, name):
    assert oracle.check(spark, name, sf) > 0
