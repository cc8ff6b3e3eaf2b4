"""Stored tables, files, queues, the asynchronous wrapper and the command line."""

import io
import random

import pytest
from pyspark.sql import functions as F

from keyweave.__main__ import run
from keyweave.asynchronous import AsyncTable
from keyweave.model import Status, StatusError
from keyweave.sources import records
from keyweave.streaming import queues
from keyweave.table import open_table, restore

KV = "key string, value string"


def state(t):
    return {r.key: r.value for r in t.df().collect()}


@pytest.mark.parametrize("dbm", ["hash", "baby"])
def test_table(spark, tmp_path, dbm):
    t = open_table(spark, f"file://{tmp_path}/t" if dbm == "hash" else "", dbm=dbm)
    assert t.is_ordered == (dbm == "baby") and t.count() == 0
    assert t.set_multi({"a": "1", "b": "2"}) == Status.SUCCESS
    assert t.set("a", "x", overwrite=False) == Status.DUPLICATION and t.get("a") == "1" and t.get("q", "-") == "-"
    assert t.remove("zz") == Status.NOT_FOUND and t.append("a", "2", ",") == Status.SUCCESS
    assert t.increment("n", 5, 100) == 105 and t.increment("n", 1) == 106
    assert t.compare_exchange("b", "9", "z") == Status.INFEASIBLE and t.compare_exchange("b", "2", "z") == Status.SUCCESS
    assert t.rekey("n", "m") == Status.SUCCESS and t.rekey("n", "m") == Status.NOT_FOUND
    assert state(t) == {"a": "1,2", "b": "z", "m": "106"}
    assert t.pop_first() == ("a", "1,2") and [r.key for r in t.search("begin", "m").collect()] == ["m"]
    t.insert(spark.createDataFrame([("b", 1, "new")], "key string, seq long, value string"))
    assert state(t)["b"] == "z"
    t.synchronize("concat")
    assert state(t)["b"] == "znew"
    t.process_each(F.upper("value"), F.col("key") != "m")
    assert state(t) == {"b": "ZNEW"}
    t.rebuild()
    t.clear()
    assert state(t) == {} and t.pop_first() is None
    t.close()
    with pytest.raises(StatusError):
        t.df()


def test_equal_keys_are_one_record(spark):
    t = open_table(spark, dbm="stdtree", key_comparator="lexicalcase")
    t.set_multi({"Apple": "1"})
    t.set_multi([("APPLE", "2"), ("pear", "3"), ("PEAR", "4")])
    assert t.get("apple") == "2" and sorted(v for v in state(t).values()) == ["2", "4"] and "Apple" in state(t)


def test_random_operations(spark):
    rnd = random.Random(7)
    t, model = open_table(spark, dbm="tiny"), {}
    for _ in range(12):
        ks = [str(rnd.randrange(20)) for _ in range(6)]
        kind = rnd.choice(["set", "add", "append", "remove"])
        pairs = [(k, rnd.choice("xyz")) for k in ks]
        if kind == "set":
            t.set_multi(pairs)
            model |= dict(pairs)
        elif kind == "add":
            t.set_multi(pairs, overwrite=False)
            for k, v in pairs:
                model.setdefault(k, v)
        elif kind == "append":
            t.append_multi(pairs, ":")
            for k, v in pairs:
                model[k] = f"{model[k]}:{v}" if k in model else v
        else:
            t.remove_multi(ks)
            for k in ks:
                model.pop(k, None)
        assert state(t) == model


def test_update_logger_mirrors_the_table(spark):
    from keyweave.operators import changelog

    log = []
    t = open_table(spark, dbm="tiny", log=lambda d: log.extend((r.op, r.key, r.value) for r in d.collect()))
    t.set_multi({str(i): str(i * i) for i in range(1, 10)})
    t.remove("3")
    t.clear()
    t.set("1", "one")
    frame = spark.createDataFrame([(0, i, o, 0, 0, k, v) for i, (o, k, v) in enumerate(log)], "ts long, seq long, op string, server_id int, dbm_index int, key string, value string")
    mirror = changelog.replay(spark.createDataFrame([], KV), frame)
    assert {r.key: r.value for r in mirror.collect()} == state(t) == {"1": "one"} and len(log) == 12


def test_files(spark, tmp_path):
    t = open_table(spark, dbm="tiny")
    data = {"a\tb": "1\n2", "c": "", "é": "x" * 100_000, "t": "a\tb"}
    t.set_multi(data)
    t.export_flat(f"{tmp_path}/flat")
    back = open_table(spark, dbm="tiny")
    back.import_flat(f"{tmp_path}/flat")
    assert state(back) == data
    t.export_tsv(f"{tmp_path}/esc", escape=True)
    back.clear()
    back.import_tsv(f"{tmp_path}/esc", unescape=True)
    assert state(back) == data
    t.export_tsv(f"{tmp_path}/tsv")
    back.clear()
    back.import_tsv(f"{tmp_path}/tsv")
    assert state(back) == {"a b": "1 2", "c": "", "é": "x" * 100_000, "t": "a\tb"}
    t.export_key_lines(f"{tmp_path}/keys")
    assert sorted(r.line for r in records.read_lines(spark, f"{tmp_path}/keys").collect())[-1] == "é"
    (tmp_path / "lines.tsv").write_text("a\t1\nno tab\nb\t2\t3\na\t9\n")
    assert {r.key: r.value for r in records.import_tsv(spark, f"{tmp_path}/lines.tsv").collect()} == {"a": "9", "b": "2\t3"}


def test_flat_record_codec():
    out = io.BytesIO()
    records.write_flat(out, b"meta", True)
    records.write_flat(out, b"x" * 300)
    data = out.getvalue()
    assert data[:2] == b"\xfe\x04" and list(records.read_flat(io.BytesIO(data))) == [(True, b"meta"), (False, b"x" * 300)]
    for bad in (b"\x00", data[:-1], b"\xff\x81"):
        with pytest.raises(StatusError):
            list(records.read_flat(io.BytesIO(bad)))


def test_queue_files(spark, tmp_path):
    messages = [(100, b"a"), (90, b""), (120, b"b" * 500), (130, b"c")]
    files = records.write_queue(f"{tmp_path}/q", messages, max_file_size=200)
    assert len(files) > 1
    records.register(spark)
    df = spark.read.format("queuefiles").option("path", str(tmp_path)).load()
    rows = df.orderBy("file_id", "file_offset").collect()
    assert [(r.timestamp_ms, bytes(r.message)) for r in rows] == [(100, b"a"), (100, b""), (120, b"b" * 500), (130, b"c")]
    assert spark.read.format("queuefiles").option("path", str(tmp_path)).option("min_timestamp", "120").load().count() == 2
    raw = bytearray((tmp_path / "q.0000000000").read_bytes())
    raw[-2] ^= 1
    with pytest.raises(StatusError):
        list(records.read_queue(io.BytesIO(raw)))
    assert len(list(records.read_queue(io.BytesIO(raw), ignore_broken=True))) == len(list(records.read_queue(io.BytesIO(raw[:-1]))))


def test_streaming_queue(spark, tmp_path):
    src, sink = f"{tmp_path}/src", f"{tmp_path}/sink"
    batch = lambda n: [("q", 1, 32 + i, 1000 + i, bytearray(b"m")) for i in range(n, n + 10)]
    spark.createDataFrame(batch(0), queues.SCHEMA).write.parquet(src)

    def handle(df, number):
        df.write.mode("overwrite").parquet(f"{sink}/{number}")

    for n, seen in ((10, 5), (20, 20)):  # the second time ten new messages and five repeated ones
        q = queues.poll(queues.tail(spark, src, min_timestamp=1005), handle, f"{tmp_path}/cp")
        q.awaitTermination()
        assert spark.read.parquet(f"{sink}/*").count() == seen
        spark.createDataFrame(batch(n) + batch(0), queues.SCHEMA).write.mode("append").parquet(src)
    q = queues.poll(queues.deduplicate(queues.tail(spark, src)), handle, f"{tmp_path}/cp2")
    q.awaitTermination()
    assert spark.read.parquet(f"{sink}/*").select("file_offset").distinct().count() == 30


def test_deduplication_keeps_late_first_arrivals(spark, tmp_path):
    src, sink, hour = f"{tmp_path}/src", f"{tmp_path}/sink", 3_600_000
    message = lambda q, offset, t: (q, 1, offset, t, bytearray(b"m"))
    ahead = [message("ahead", 32 + i, 100 * hour + i) for i in range(5)]
    lagging = [message("lagging", 32 + i, hour + i) for i in range(5)]  # 99 hours behind
    later = [message("ahead", 99, 50 * hour), message("ahead", 100, 200 * hour)]  # out of order
    again = [message("ahead", 32, 300 * hour), *lagging]  # a name seen 200 hours before

    def handle(df, number):
        df.write.mode("overwrite").parquet(f"{sink}/{number}")

    for part in (ahead, lagging + later + ahead, again):
        spark.createDataFrame(part, queues.SCHEMA).coalesce(1).write.mode("append").parquet(src)
        queues.poll(queues.deduplicate(queues.tail(spark, src)), handle, f"{tmp_path}/cp").awaitTermination()
    got = [(r.queue_prefix, r.file_offset, r.timestamp_ms) for r in spark.read.parquet(f"{sink}/*").collect()]
    assert sorted(got) == sorted((q, o, t) for q, _, o, t, _ in ahead + lagging + later)


def test_queue_frames(spark):
    rows = [("q", f, 32 + i, t, None) for f, times in ((1, [5, 3, 9]), (2, [20, 10]), (3, [1])) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, queues.SCHEMA)
    assert [(r.file_id, r.last_ms) for r in queues.old_files(df, 10).collect()] == [(1, 9)]
    assert queues.old_files(df, 10, exclude_latest=False).count() == 2 and queues.retain(df, 10).count() == 3
    assert [r.timestamp_ms for r in queues.monotone(df).orderBy("file_id", "file_offset").collect()] == [5, 5, 9, 20, 20, 1]


def test_async(spark):
    done = []
    with AsyncTable(open_table(spark, dbm="tiny"), on_done=lambda n, o: done.append((n, o))) as t:
        t.set("a", "1")
        t.append("a", "2")
        assert t.get("a").result() == "12"
        bad = t.submit("search", "foo", "x")
        assert isinstance(bad.exception(), StatusError)
        with pytest.raises(AttributeError):
            t.nothing  # noqa: B018
    assert [n for n, _ in done] == ["set", "append", "get", "search"] and done[0][1] == Status.SUCCESS


def test_command_line(spark, tmp_path, capsys):
    p = f"file://{tmp_path}/t"
    assert run(spark, ["create", p]) == 0
    assert run(spark, ["set", p, "b", "2"]) == 0 and run(spark, ["set", p, "a", "1"]) == 0
    assert run(spark, ["set", p, "a", "x", "--keep"]) == 1 and run(spark, ["get", p, "nope"]) == 1
    capsys.readouterr()
    assert run(spark, ["list", p]) == 0 and capsys.readouterr().out == "a\t1\nb\t2\n"
    assert run(spark, ["list", p, "--move", "jumplower", "--jump-key", "b", "--keys"]) == 0 and capsys.readouterr().out == "a\n"
    assert run(spark, ["export", p, f"{tmp_path}/x", "--tsv"]) == 0 and run(spark, ["remove", p, "a"]) == 0
    assert run(spark, ["import", p, f"{tmp_path}/x", "--tsv"]) == 0 and run(spark, ["get", p, "a"]) == 0
    assert capsys.readouterr().out.strip() == "1"
    assert run(spark, ["search", p, "foo", "x"]) == 1
    assert {r.key for r in restore(spark, p).collect()} == {"a", "b"}


def test_signals(spark, tmp_path):
    from keyweave.streaming.signals import Signal

    src, counted = f"{tmp_path}/src", []
    spark.createDataFrame([("q", 1, 32, 1, None)], queues.SCHEMA).write.parquet(src)
    signal = Signal(on_rows=lambda name, n: counted.append(n)).attach(spark)
    try:
        assert not signal.wait(0.01)
        queues.poll(queues.tail(spark, src), lambda df, number: df.count() and None, f"{tmp_path}/cp").awaitTermination()
        assert signal.wait(30, 1)  # the rows, and the end
    finally:
        signal.detach(spark)
    assert sum(counted) == 1
