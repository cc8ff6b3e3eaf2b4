"""Row-level writes, cursors, caches, sharded tables, stored indices, update logs and paths."""

import random

import pytest
from pyspark.sql import functions as F

from keyweave.__main__ import run
from keyweave.functions import strings, times
from keyweave.functions.hashes import cache_slot_of
from keyweave.model import Status, StatusError
from keyweave.operators import cache
from keyweave.sharded import ShardedTable, rename_shards, restore_shards, shard_paths
from keyweave.sources import paths, records, update_logs
from keyweave.stored_index import StoredIndex
from keyweave.streaming.signals import KeySignal
from keyweave.table import REMOVE, open_table, restore


def state(t):
    return {r.key: r.value for r in t.df().collect()}


def files(t):
    return {r.file for r in t._store.manifest().collect()}


def test_a_change_of_one_key_rewrites_no_file(spark, tmp_path):
    t = open_table(spark, f"file://{tmp_path}/t", dbm="tree")
    for part in range(3):
        t.set_multi({f"k{part}{i:03d}": str(i) for i in range(100)})
    before, read = files(t), []
    near = t._near

    def watched(keys, version):
        found = near(keys, version)
        read.extend(f for f in found.inputFiles() if "/data/" in f)
        return found

    t._near = watched
    t.set("k1050", "new")
    assert files(t) > before and len(files(t) - before) == 1
    assert len(read) < len(before)  # only files whose ends enclose the key
    t.remove("k2007")
    assert before <= files(t) and t.get("k1050") == "new" and t.get("k2007") is None and t.count() == 299
    assert t.file_size() > 0 and t.timestamp() > 1e9
    t.rebuild()
    assert not before & files(t) and t.count() == 299 and t.get("k1050") == "new"


def test_kinds_by_name(spark, tmp_path):
    kinds = {"x.tree": "tree", "x.SKIP": "skip", "x.hash": "hash", "x": "hash", "x.other": "hash", "x.cache": "cache"}
    assert {p: open_table(spark, f"file://{tmp_path}/{p}").kind for p in kinds} == kinds
    with pytest.raises(StatusError):
        open_table(spark, "x", dbm="flat")


@pytest.mark.parametrize("stored", [False, True])
def test_equal_keys_are_one_record_for_every_operation(spark, tmp_path, stored):
    t = open_table(spark, f"file://{tmp_path}/t.tree" if stored else "", dbm="tree" if stored else "baby", key_comparator="lexicalcase")
    t.set_multi({"Apple": "1", "pear": "2"})
    assert t.increment("APPLE", 1) == 2 and t.increment("apple", -(2**63)) == 2 and t.increment("none", -(2**63)) is None
    t.process_multi(spark.createDataFrame([("PEAR", 1, "append", "x"), ("Pear", 2, "append", "y"), ("FIG", 3, "set", "f"), ("fig", 4, "append", "g")], "key string, seq long, op string, value string"))
    assert state(t) == {"Apple": "2", "pear": "2xy", "FIG": "fg"}
    assert t.compare_exchange("aPPLE", "2", "3") == Status.SUCCESS and t.rekey("PEAR", "apple", overwrite=False) == Status.DUPLICATION
    assert t.rekey("PEAR", "APPLE") == Status.SUCCESS and state(t) == {"Apple": "2xy", "FIG": "fg"}
    t.process(lambda pdf: pdf[["key", "value"]].assign(value=pdf.value + "!"), ["fIG"])
    assert t.remove("APPle") == Status.SUCCESS and state(t) == {"FIG": "fg!"}


def test_an_order_of_ones_own(spark):
    t = open_table(spark, dbm="baby", key_comparator=lambda k: [F.length(k)])
    t.set_multi([("bbb", "1"), ("a", "2"), ("ccc", "3")])
    assert [r.key for r in t.first(5).collect()] == ["a", "bbb"] and t.get("zzz") == "3"


def test_read_only(spark):
    t = open_table(spark, dbm="tiny", writable=False)
    assert not t.is_writable and t.is_healthy
    with pytest.raises(StatusError):
        t.set("a", "1")


def test_cursor(spark, tmp_path):
    t = open_table(spark, f"file://{tmp_path}/t.tree")
    t.set_multi({k: k.upper() for k in "bdfh"})
    c = t.cursor()
    assert c.get() is None and c.next() == Status.NOT_FOUND
    assert c.first() == Status.SUCCESS and c.get() == ("b", "B") and c.step() == ("b", "B") and c.get() == ("d", "D")
    assert c.set("dd") == Status.SUCCESS and c.get() == ("d", "dd")
    assert c.remove() == Status.SUCCESS and c.get() == ("f", "F") and c.previous() == Status.SUCCESS and c.get() == ("b", "B")
    assert c.jump("g") == Status.SUCCESS and c.get() == ("h", "H") and c.jump_lower("f") == Status.SUCCESS and c.get() == ("b", "B")
    assert c.jump_upper("f", True) == Status.SUCCESS and c.process(lambda k, v: REMOVE) == Status.SUCCESS and c.get() is None
    assert c.last() == Status.SUCCESS and c.process(lambda k, v: v + k) == Status.SUCCESS and state(t) == {"b": "B", "h": "Hh"}
    assert t.process_first(lambda k, v: None) == Status.SUCCESS and t.process_first(lambda k, v: REMOVE) == Status.SUCCESS and state(t) == {"h": "Hh"}
    seen = []
    t.process_each(F.lower("value"), begin=lambda: seen.append("begin"), end=lambda: seen.append("end"))
    assert seen == ["begin", "end"] and state(t) == {"h": "hh"}


def test_a_cache_evicts_on_writes_and_reading_is_a_use(spark):
    t = open_table(spark, dbm="cache", cap_rec_num=32)  # two records a slot
    names = [(f"k{i}",) for i in range(300)]
    slot = {r.k: r.s for r in spark.createDataFrame(names, "k string").select("k", cache_slot_of(F.col("k"), cache.SLOTS).alias("s")).collect()}
    a, b, c, d = [k for (k,) in names if slot[k] == slot["k0"]][:4]
    t.set(a, "1")
    t.set(b, "2")
    assert t.get(a) == "1"
    t.set(c, "3")
    assert set(state(t)) == {a, c}
    t.set(d, "4")
    assert set(state(t)) == {c, d}
    t.set_multi({k: "x" for (k,) in names})
    assert t.count() == sum(min(2, list(slot.values()).count(s)) for s in set(slot.values()))


def test_restore_honours_removals(spark, tmp_path):
    t = open_table(spark, f"file://{tmp_path}/t")
    t.set_multi({"a": "1", "b": "2"})
    t.remove("a")
    t.set("b", "3")
    assert {r.key: r.value for r in restore(spark, t.path).collect()} == {"b": "3"}
    latest = sorted((tmp_path / "t" / "_versions").glob("*.json"))[-1]
    latest.write_text("{ broken")
    for crc in (tmp_path / "t" / "_versions").glob(".*.crc"):
        crc.unlink()
    assert {r.key: r.value for r in restore(spark, t.path).collect()} == {"b": "2"}


def test_sharded_table(spark, tmp_path):
    rnd, path = random.Random(4), f"file://{tmp_path}/s"
    t, model = ShardedTable(spark, path, num_shards=2), {}
    data = {f"k{i}": str(i) for i in range(40)}
    t.set_multi(data)
    model |= data
    assert all(s.count() for s in t.shards) and t.get("k7") == "7" and state(t) == model
    keys = rnd.sample(sorted(data), 10)
    assert t.remove_multi(keys) == Status.SUCCESS and t.remove("nope") == Status.NOT_FOUND
    for k in keys:
        del model[k]
    left = sorted(model)
    assert t.append(left[0], "x", ",") == Status.SUCCESS and t.increment(left[1], 5) == int(model[left[1]]) + 5
    model |= {left[0]: model[left[0]] + ",x", left[1]: str(int(model[left[1]]) + 5)}
    assert t.rekey(left[2], "other") == Status.SUCCESS
    model["other"] = model.pop(left[2])
    assert [r.key for r in t.first(4).collect()] == sorted(model)[:4] and t.pop_first()[0] == min(model)
    del model[min(model)]
    ops = spark.createDataFrame([(k, "value", v, "value", "!") for k, v in [*list(model.items())[:5], ("none", "0")]], "key string, expected_kind string, expected string, desired_kind string, desired string")
    assert t.compare_exchange_multi(ops) == Status.INFEASIBLE and state(t) == model
    assert len(shard_paths(spark, path)) == 2 and ShardedTable(spark, path).count() == len(model)
    assert rename_shards(spark, path, f"file://{tmp_path}/r") == Status.SUCCESS and rename_shards(spark, path, path) == Status.NOT_FOUND
    assert state(restore_shards(spark, f"file://{tmp_path}/r", f"file://{tmp_path}/n")) == model
    with pytest.raises(StatusError):
        ShardedTable(spark, f"file://{tmp_path}/r", num_shards=3)


def test_stored_index(spark, tmp_path):
    x = StoredIndex(spark, f"file://{tmp_path}/x", ("string", "long"))
    x.add_multi([("b", 2), ("a", 1), ("b", 1), ("a", 1), (None, 5)])
    assert x.count() == 3 and x.add("a", 1) == Status.SUCCESS and x.count() == 3
    assert x.check("b", 2) and not x.check("b", 9) and x.get_values("b") == [1, 2] and x.get_values("b", 1) == [1]
    c = x.cursor()
    c.first()
    walk = [c.get()]
    while c.next() == Status.SUCCESS:
        walk.append(c.get())
    assert walk == [("a", 1), ("b", 1), ("b", 2)]
    assert c.last() == Status.SUCCESS and c.previous() == Status.SUCCESS and c.get() == ("b", 1)
    assert c.jump("b", 2) == Status.SUCCESS and c.get() == ("b", 2) and c.jump("c") == Status.NOT_FOUND
    assert x.remove("b", 2) == Status.SUCCESS and x.remove("b", 2) == Status.NOT_FOUND and x.get_values("b") == [1]
    x.refresh(spark.createDataFrame([(1, "a", "z"), (1, "b", None), (7, None, "q"), (8, "q", "q")], "pkey long, old_ikey string, new_ikey string"))
    assert sorted(tuple(r) for r in x.df().collect()) == [("q", 7), ("z", 1)]
    x.rebuild()
    assert x.count() == 2
    x.clear()
    assert x.count() == 0 and x.cursor().first() == Status.NOT_FOUND and x.get_values("z") == []


def test_loggers_and_replay(spark, tmp_path):
    lines, mirror = update_logs.LineLogger(), open_table(spark, dbm="tiny")
    folder = f"{tmp_path}/q"
    (tmp_path / "q").mkdir()
    clock = iter(range(100, 200))
    with records.QueueWriter(f"{folder}/log", max_file_size=60) as w:
        queue = update_logs.QueueLogger(w, 3, 1, clock=lambda: next(clock))
        t = open_table(spark, dbm="tiny", log=lambda d: [each(d) for each in (lines, update_logs.TableLogger(mirror), queue)])
        t.set("a", "1")
        t.set("b", "2")
        t.set("a", "3")
        t.remove("b")
        t.clear()
        t.set("c", "4")
    assert list(lines.lines) == ["SET\ta\t1", "SET\tb\t2", "SET\ta\t3", "REMOVE\tb", "CLEAR", "SET\tc\t4"]
    assert lines.pop_front() == "SET\ta\t1" and lines.pop_back() == "SET\tc\t4" and state(mirror) == state(t) == {"c": "4"}
    assert len(records.queue_paths(f"{folder}/log")) > 1
    log = update_logs.read_log(spark, folder)
    assert {(r.server_id, r.dbm_index) for r in log.collect()} == {(3, 1)}
    again = open_table(spark, f"file://{tmp_path}/again")
    again.set("old", "x")
    update_logs.apply_log_files(again, folder, server_id=9)
    assert state(again) == {"old": "x"}
    update_logs.apply_log_files(again, folder, server_id=3)
    assert state(again) == {"c": "4"}
    partial = open_table(spark, dbm="tiny")
    update_logs.apply_log_files(partial, folder, min_timestamp=105_000)
    assert state(partial) == {"c": "4"}
    n = len(records.queue_paths(f"{folder}/log"))
    gone = update_logs.remove_old_files(spark, folder, 10**12)
    assert len(gone) == n - 1 and len(records.queue_paths(f"{folder}/log")) == 1
    assert len(update_logs.remove_old_files(spark, folder, 10**12, exclude_latest=False)) == 1 and not records.queue_paths(f"{folder}/log")


def test_queue_writer_takes_up_where_it_ended(tmp_path):
    prefix = f"{tmp_path}/q"
    with records.QueueWriter(prefix, 80) as w:
        assert [w.write(t, b"m" * 20) for t in (50, 40, 60)] == [50, 50, 60]
    held = records.queue_paths(prefix)
    with records.QueueWriter(prefix, 80) as w:
        assert w.last == 60
        w.update_timestamp(90)
        assert w.write(70, b"late") == 90
    with records.QueueWriter(prefix) as w:
        assert w.last == 90 and w.write(0, b"z") == 90
    assert records.queue_paths(prefix)[: len(held)] == held
    got = []
    for p in records.queue_paths(prefix):
        with open(p, "rb") as f:
            got += [(t, m) for _, t, m in records.read_queue(f)]
    assert [t for t, _ in got] == [50, 50, 60, 90, 90] and [m for _, m in got][-2:] == [b"late", b"z"]
    with open(records.queue_paths(prefix)[-1], "ab") as f:
        f.write(b"\xff\0\0")  # a record that was cut off
    with records.QueueWriter(prefix) as w:
        w.write(100, b"after")
    with open(records.queue_paths(prefix)[-1], "rb") as f:
        assert [m for *_, m in records.read_queue(f)] == [b"after"]


def test_log_commands(spark, tmp_path, capsys):
    folder, prefix = str(tmp_path), f"{tmp_path}/log"
    for argv in (["writeset", prefix, "a", "1", "--timestamp", "10"], ["writeset", prefix, "b", "2", "--timestamp", "20", "--server-id", "5"], ["writeremove", prefix, "a", "--timestamp", "30"]):
        assert run(spark, argv) == 0
    capsys.readouterr()
    assert run(spark, ["readlog", folder]) == 0
    assert capsys.readouterr().out == "10000\t0\t0\tSET\ta\t1\n20000\t5\t0\tSET\tb\t2\n30000\t0\t0\tREMOVE\ta\t\n"
    assert run(spark, ["readlog", folder, "--server-id", "5", "--min-timestamp", "15000"]) == 0 and capsys.readouterr().out == "20000\t5\t0\tSET\tb\t2\n"
    assert run(spark, ["listfiles", folder]) == 0 and capsys.readouterr().out.startswith("log\t0\t3\t32\t")
    assert run(spark, ["writeclear", prefix]) == 0 and run(spark, ["removeoldfiles", folder, "1", "--all"]) == 0 and capsys.readouterr().out == ""
    t, u = f"file://{tmp_path}/t", f"file://{tmp_path}/u"
    assert run(spark, ["set", t, "a", "1"]) == 0 and run(spark, ["set", t, "a", "2", "--reducer", "concat"]) == 0
    assert run(spark, ["get", t, "a,b", "--multi"]) == 0 and capsys.readouterr().out == "a\t12\n"
    assert run(spark, ["restore", t, u]) == 0 and run(spark, ["set", u, "z", "9"]) == 0 and run(spark, ["merge", t, u]) == 0
    (tmp_path / "out").mkdir()
    assert run(spark, ["export", t, f"{tmp_path}/out/x", "--log"]) == 0 and run(spark, ["import", f"file://{tmp_path}/v", f"{tmp_path}/out", "--log"]) == 0
    assert state(open_table(spark, f"file://{tmp_path}/v")) == {"a": "12", "z": "9"}


def test_key_signal(spark):
    import threading

    signal, woken = KeySignal(), []
    waiter = threading.Thread(target=lambda: woken.append(signal.wait("a", 30)))
    waiter.start()
    while not signal._waiting["a"]:
        pass
    t = open_table(spark, dbm="tiny", log=signal)
    t.set("b", "1")
    assert waiter.is_alive()
    t.set("a", "1")
    waiter.join(30)
    assert woken == [True] and not signal.send("a") and not signal.wait("a", 0.01)


def test_line_numbers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    want = []
    for name, n in (("a", 5), ("b", 4000), ("c", 1)):
        lines = [f"{name}{i} " + "x" * 50 for i in range(n)]
        want += lines
        (tmp_path / "d" / f"{name}.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.line_no: r.line for r in records.read_lines(spark, f"{tmp_path}/d").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(want))


def test_paths(tmp_path):
    assert paths.join("/a", "b") == "/a/b" and paths.join("/a/", "/b") == "/b" and paths.join("", "x") == "x"
    assert [paths.normalize(p) for p in ("/a//b/./../c", "a/../b/", "//x", "", "/..")] == ["/a/c", "b", "/x", "", "/"]
    assert [paths.base_name(p) for p in ("/a/b.c", "/a/", "/", "x", "")] == ["b.c", "a", "/", "x", ""]
    assert [paths.directory(p) for p in ("/a/b", "/a", "/", "x", "a/b/")] == ["/a", "/", "/", ".", "a"]
    assert [paths.extension(p) for p in ("/a/b.c.d", "/a.b/c", "x.")] == ["d", "", ""]
    paths.write(f"{tmp_path}/f", b"one")
    paths.write(f"file://{tmp_path}/f", b"two")
    paths.copy(f"{tmp_path}/f", f"{tmp_path}/g")
    assert paths.read(f"{tmp_path}/g") == b"two" and paths.children(str(tmp_path)) == ["f", "g"] and paths.exists(f"{tmp_path}/f")
    paths.remove(f"{tmp_path}/g")
    for missing in (lambda: paths.read(f"{tmp_path}/g"), lambda: paths.remove(f"{tmp_path}/g")):
        with pytest.raises(StatusError):
            missing()


def test_small_functions(spark):
    df = spark.createDataFrame([({"a": "1"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(strings.search_map(F.col("m"), "a", "-")).collect()] == ["1", "-", "-"]
    t = spark.createDataFrame([(0.0,), (1720000000.5,), (None,)], "t double")
    assert [r[0] for r in t.select(times.local_difference(F.col("t"), "Europe/Berlin")).collect()] == [3600, 7200, None]
    assert [r[0] for r in t.select(times.local_difference(F.col("t"))).collect()] == [0, 0, None]
