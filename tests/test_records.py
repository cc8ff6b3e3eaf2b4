"""Record, scan, search, reduce, index, log, cache and shard operators on small fixtures."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyweave.functions import codecs
from keyweave.model import Status, StatusError, batch_status, sort_keys
from keyweave.operators import cache, changelog, index, point, reduce, scan, search, shard

KV = "key string, value string"


def kv(spark, pairs):
    return spark.createDataFrame(list(pairs), KV)


def keys(df):
    return [r.key for r in df.collect()]


def as_dict(df):
    rows = df.collect()
    out = {r.key: r.value for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def decimal(spark):
    return kv(spark, [(str(i), "") for i in range(1, 101)]).cache()


# Search: known results over the decimal numbers 1 to 100


@pytest.mark.parametrize(
    "mode,pattern,n",
    [
        ("contain", "1", 20), ("begin", "1", 12), ("end", "1", 10), ("regex", "1$", 10), ("regex", "(?ie)1$", 10), ("containcase", "1", 20),
        ("containword", "1", 1), ("containcaseword", "1", 1), ("contain*", "2\n3", 36), ("containcase*", "2\n3", 36), ("containword*", "2\n3", 2),
        ("containcaseword*", "2\n3", 2),
    ],
)
def test_search_counts(decimal, mode, pattern, n):
    assert search.search(decimal, mode, pattern).count() == n
    assert search.search(decimal, mode, pattern, 3).count() == min(3, n)
    lines = decimal.select(F.col("key").alias("line"), F.col("key").cast("long").alias("line_no"))
    assert search.search_text(lines, mode, pattern).count() == n


def test_search_ranked(decimal):
    assert keys(search.search(decimal, "edit", "10", 2)) == ["10", "1"]
    assert keys(search.search(decimal, "editbin", "10", 3)) == ["10", "1", "100"]
    assert keys(search.search(decimal, "upper", "10", 3)) == ["100", "11", "12"]
    assert keys(search.search(decimal, "lowerinc", "20", 3)) == ["20", "2", "19"]


def test_search_invalid(decimal):
    for bad in (lambda: search.search(decimal, "foo", "1"), lambda: search.search(decimal, "regex", "("), lambda: search.search_text(decimal, "upper", "1")):
        with pytest.raises(StatusError) as e:
            bad()
        assert e.value.status == Status.INVALID_ARGUMENT


def test_search_odd_keys(spark):
    df = kv(spark, [(None, "n"), ("", "e"), ("x" * 50_000 + "needle", "l"), ("é_a", "u")]).withColumn("distance", F.lit(7))
    assert search.search(df, "contain", "needle").count() == 1
    assert search.search(df, "contain", "").count() == 3
    assert keys(search.search(df, "edit", "ea", 1)) == [""]
    assert search.search(df, "containword", "a").count() == 1  # the underscore is no letter
    assert search.search(df.limit(0), "edit", "x", 3).count() == 0


def test_search_lambda(decimal):
    assert sorted(keys(search.search_lambda(decimal, lambda k: k.str.len() == 3))) == ["100"]


# Ranges


def test_ranges_padded(spark):
    df = kv(spark, [(f"{i:08d}", "") for i in range(1, 101)])
    assert keys(scan.range_scan(df, "upperinc", "00000050", 3)) == ["00000050", "00000051", "00000052"]
    assert keys(scan.range_scan(df, "upper", "00000098", 3)) == ["00000099", "00000100"]
    assert keys(scan.range_scan(df, "lower", "00000050", 3)) == ["00000049", "00000048", "00000047"]
    assert keys(scan.range_scan(df, "lower", "00000003", 3)) == ["00000002", "00000001"]
    assert scan.range_scan(df, "upper", "00000050").count() == 50
    assert keys(scan.next_record(df, "00000007")) == ["00000008"] and keys(scan.previous_record(df, "00000001")) == []
    assert keys(point.get_by_index(df, 9)) == ["00000010"] and keys(point.get_by_index(df, 100)) == [] and keys(point.get_by_index(df, -1)) == []


def test_neighbours(spark):
    names = sorted({f"k{random.Random(i).randrange(500)}" for i in range(200)})
    got = {r.key: (r.previous, r.next) for r in scan.neighbours(kv(spark, [(n, "") for n in names] + [(None, "")])).collect()}
    assert got == {n: (a, b) for n, a, b in zip(names, [None, *names], [*names[1:], None])}
    tens = scan.neighbours(kv(spark, [("10", ""), ("9", ""), ("2", "")]), "decimal").collect()
    assert {r.key: r.next for r in tens} == {"2": "9", "9": "10", "10": None}
    assert scan.neighbours(kv(spark, [("a", "")]).limit(0)).collect() == []


def test_orders(spark):
    df = kv(spark, [("10", ""), ("9", ""), ("-3", ""), ("x", "")])
    assert keys(scan.in_order(df, "decimal")) == ["-3", "x", "9", "10"]
    assert keys(scan.range_scan(df, "upperinc", "9", 2, "DecimalKeyComparator")) == ["9", "10"]
    assert keys(scan.in_order(kv(spark, [("b", ""), ("A", ""), ("a", "")]), "lexicalcase")) == ["A", "a", "b"]
    assert keys(scan.in_order(kv(spark, [("0x1F", ""), ("a", ""), ("ffffffffffffffff", "")]), "hexadecimal")) == ["ffffffffffffffff", "a", "0x1F"]
    assert keys(scan.in_order(kv(spark, [("1e2", ""), ("-0.5", ""), ("3", "")]), "realnumber")) == ["-0.5", "3", "1e2"]
    with pytest.raises(StatusError):
        sort_keys("nonsense", F.col("key"))
    with pytest.raises(StatusError):
        sort_keys("pairdecimal", F.col("key"))


@pytest.mark.parametrize("size", [4, 8])
def test_float_order(spark, size):
    values = [1.5, -2.0, float("nan"), 0.0, float("inf"), float("-inf"), -0.25]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", codecs.float_to_big_endian(F.col("x"), size).alias("key"))
    got = [r.x for r in df.orderBy(*sort_keys("floatbigendian", F.col("key"))).collect()]
    assert got[0] != got[0] and got[1:] == sorted(v for v in values if v == v)


@pytest.mark.parametrize("size", [1, 2, 4, 8])
def test_signed_order(spark, size):
    values = [0, 1, -1, 100, -128, 127]
    df = spark.createDataFrame([(v,) for v in values], "x long").select("x", codecs.int_to_big_endian(F.col("x"), size).alias("key"))
    assert [r.x for r in df.orderBy(*sort_keys("signedbigendian", F.col("key"))).collect()] == sorted(values)


# Records


@pytest.mark.parametrize("seed", range(3))
def test_process_multi_is_a_replay(spark, seed):
    rnd = random.Random(seed)
    base = {k: rnd.choice([None, "", k]) for k in "abcdef"}
    ops = [(rnd.choice("aaaaabcdefghij"), i, rnd.choice(["set", "add", "append", "append", "remove"]), rnd.choice(["x", "yy", ""])) for i in range(60)]
    state = dict(base)
    for k, _, op, v in ops:
        if op == "remove":
            state.pop(k, None)
        elif op == "set" or (op == "add" and k not in state):
            state[k] = v
        elif op == "append":
            state[k] = v if state.get(k) is None else state[k] + "," + v
    rnd.shuffle(ops)
    got = point.process_multi(kv(spark, base.items()), spark.createDataFrame([*ops, (None, 1, "set", "z")], "key string, seq long, op string, value string"), ",")
    assert as_dict(got) == state


@pytest.mark.parametrize("seed", range(3))
def test_set_append_remove(spark, seed):
    rnd = random.Random(seed)
    base = {k: k * 2 for k in "abcd"}
    ops = [(rnd.choice("abefg"), i, rnd.choice(["1", "22"])) for i in range(20)]
    frame = spark.createDataFrame([(*o, "x") for o in ops], "key string, seq long, value string, found string")
    table = kv(spark, base.items()).withColumn("seq", F.lit(0)).withColumn("tail", F.lit("t"))
    assert as_dict(point.set_multi(table, frame)) == base | {k: v for k, _, v in ops}
    first = {}
    for k, _, v in ops:
        first.setdefault(k, v)
    assert as_dict(point.set_multi(table, frame, False)) == first | base
    appended = dict(base)
    for k, _, v in ops:
        appended[k] = f"{appended[k]}-{v}" if k in appended else v
    assert as_dict(point.append_multi(table, frame, "-")) == appended
    assert as_dict(point.remove_multi(table, frame)) == {k: v for k, v in base.items() if k not in first}
    statuses = point.set_status(table, frame, False).collect()
    assert len(statuses) == len(ops) and all((r.status == "SUCCESS") == (r.key not in base and r.seq == min(i for k, i, _ in ops if k == r.key)) for r in statuses)
    assert batch_status(point.set_status(table, frame, False)).head()[0] == "DUPLICATION_ERROR"
    assert batch_status(point.set_status(table, frame)).head()[0] == "SUCCESS"


def test_increment(spark):
    base = spark.createDataFrame([("a", 5), ("b", None), ("m", 2**63 - 1)], "key string, value long")
    ops = spark.createDataFrame([("a", 1, 2), ("a", 2, -10), ("b", 3, 1), ("n", 4, 7), ("m", 5, 1), ("z", 6, None)], "key string, seq long, value long")
    assert as_dict(point.increment_multi(base, ops, 100)) == {"a": -3, "b": 1, "n": 107, "m": -(2**63), "z": 100}
    raw = spark.createDataFrame([("a", bytearray(b"\x01\x00")), ("k", bytearray(b"zz"))], "key string, value binary")
    got = {k: bytes(v) for k, v in as_dict(point.increment_bytes(raw, spark.createDataFrame([("a", 1, 1)], "key string, seq long, value long"))).items()}
    assert got == {"a": b"\0\0\0\0\0\0\x01\x01", "k": b"zz"}


def test_compare_exchange(spark):
    base = kv(spark, [("a", "1"), ("b", "2"), ("c", None), ("d", "4")])
    ops = [
        ("a", "value", "1", "value", "x"), ("b", "value", "9", "value", "x"), ("c", "value", None, "remove", None), ("d", "any", None, "remove", None),
        ("e", "absent", None, "value", "new"), ("f", "absent", None, "remove", None), ("g", "any", None, "value", "no"),
    ]
    frame = spark.createDataFrame(ops, "key string, expected_kind string, expected string, desired_kind string, desired string")
    assert as_dict(point.compare_exchange(base, frame)) == {"a": "x", "b": "2", "e": "new"}
    status = {r.key: (r.found, r.actual, r.status) for r in point.compare_exchange_status(base, frame).collect()}
    assert status["b"] == (True, "2", "INFEASIBLE_ERROR") and status["g"] == (False, None, "INFEASIBLE_ERROR") and status["f"][2] == "SUCCESS"
    assert as_dict(point.compare_exchange_multi(base, frame)) == {"a": "1", "b": "2", "c": None, "d": "4"}
    good = frame.filter("key NOT IN ('b', 'g')")
    assert as_dict(point.compare_exchange_multi(base, good)) == {"a": "x", "b": "2", "e": "new"}
    assert as_dict(point.compare_exchange_multi(base, good.limit(0))) == as_dict(base)


def test_rekey(spark):
    base = kv(spark, [("a", "1"), ("b", "2")])
    ops = spark.createDataFrame([("a", "c"), ("x", "y")], "old_key string, new_key string")
    assert as_dict(point.rekey(base, ops)) == {"c": "1", "b": "2"}
    assert as_dict(point.rekey(base, ops, copying=True)) == {"a": "1", "c": "1", "b": "2"}
    onto = spark.createDataFrame([("a", "b")], "old_key string, new_key string")
    assert as_dict(point.rekey(base, onto)) == {"b": "1"}
    assert as_dict(point.rekey(base, onto, overwrite=False)) == {"a": "1", "b": "2"}
    assert [r.status for r in point.rekey_status(base, onto, False).collect()] == ["DUPLICATION_ERROR"]


def test_queue_of_records(spark):
    base = kv(spark, [("b", "2"), ("a", "1")])
    first, rest = point.pop_first(base)
    assert as_dict(first) == {"a": "1"} and as_dict(rest) == {"b": "2"}
    rnd = random.Random(0)
    held = sorted({int(100 * 1e8) + rnd.randrange(12) for _ in range(6)})
    pushes = [(rnd.choice([100.0, 100.00000003, 161.0]), i, f"v{i}") for i in range(12)]
    table = spark.createDataFrame([(bytearray(h.to_bytes(8, "big")), "old") for h in held], "key binary, value string")
    got = point.push_last(table, spark.createDataFrame(pushes, "wtime double, seq long, value string")).collect()
    numbers = {r.value: int.from_bytes(r.key, "big") for r in got if r.value != "old"}
    assert len({bytes(r.key) for r in got}) == len(got) == len(held) + 12
    taken, want = set(held), {}
    for wtime, _, v in sorted(pushes):
        n = int(wtime * 1e8)
        while n in taken:
            n += 1
        taken.add(n)
        want[v] = n
    assert numbers == want


def test_process_user_code(spark):
    base = kv(spark, [("a", "1"), ("b", "2")])
    assert as_dict(point.process(base, lambda p: p[p.key != "a"])) == {"b": "2"}
    asked = spark.createDataFrame([("a",), ("z",)], "key string")
    got = point.process(base, lambda p: p.assign(value=p.value.where(p.found, "made"))[["key", "value"]], asked)
    assert as_dict(got) == {"a": "1", "b": "2", "z": "made"}


def test_empty_batches(spark):
    base, none = kv(spark, [("a", "1")]), spark.createDataFrame([], "key string, seq long, value string, op string")
    for got in (point.set_multi(base, none), point.append_multi(base, none), point.remove_multi(base, none), point.process_multi(base, none)):
        assert as_dict(got) == {"a": "1"}
    assert as_dict(point.set_multi(base.limit(0), none)) == {} and batch_status(point.set_status(base, none)).head()[0] == "SUCCESS"


# Reduce


@pytest.mark.parametrize(
    "name,want",
    [
        ("first", ["a", "11"]), ("second", ["b", "22"]), ("last", ["c", "33"]), ("concat", ["abc", "112233"]), ("concattab", ["a\tb\tc", "11\t22\t33"]),
        ("ReduceConcatWithLine", ["a\nb\nc", "11\n22\n33"]), ("concatnull", ["a\0b\0c", "11\x0022\x0033"]), ("total", ["0", "66"]),
    ],
)
def test_reducers(spark, name, want):
    rows = [("x", 2, "b"), ("x", 1, "a"), ("x", 3, "c"), ("y", 1, "11"), ("y", 3, "33"), ("y", 2, "22")]
    df = reduce.merge_runs(spark.createDataFrame(rows, "key string, seq long, value string"))
    got = as_dict(reduce.reduce_rows(df, name))
    assert [got["x"], got["y"]] == want


def test_reduce_more(spark):
    be = spark.createDataFrame([("x", bytearray.fromhex(h)) for h in ("1001", "2002", "3003")] + [("y", bytearray(b"\xff" * 8)), ("y", bytearray(b"\x02"))], "key string, value binary")
    got = as_dict(reduce.synchronize(be, None, "totalbe"))
    assert bytes(got["x"]).hex() == "0000000000006006" and bytes(got["y"]).hex() == "0000000000000001"
    rows = [("x", 1, "a", "SET"), ("x", 2, None, "REMOVE"), ("x", 3, "c", "SET"), ("y", 1, "b", "SET"), ("y", 2, None, "REMOVE"), (None, 1, "n", "SET")]
    pending = spark.createDataFrame(rows, "key string, seq long, value string, op string")
    base = kv(spark, [("x", "old"), ("z", "kept")])
    assert as_dict(reduce.synchronize(base, pending, "concat")) == {"x": "c", "z": "kept"}
    assert as_dict(reduce.synchronize(base, None, "second")) == {"x": "old", "z": "kept"}
    assert reduce.synchronize(base, kv(spark, [("x", "old")]), None).count() == 3
    merged = [kv(spark, [("x", "m1")]), kv(spark, [("x", "m2")])]
    assert as_dict(reduce.synchronize(base, kv(spark, [("x", "new")]), "concattab", merged))["x"] == "m1\tm2\told\tnew"
    user = reduce.reduce_with(reduce.merge_runs(base, kv(spark, [("x", "n")])), lambda p: p[["key", "value"]].head(2), KV)
    assert user.count() == 3
    with pytest.raises(StatusError):
        reduce.reduce_rows(pending, "median")


def test_upper_case_while_merging(spark):
    letters = kv(spark, [(c * 3, c * 5) for c in "abcdefghijklmnopqrstuvwxyz"])
    got = reduce.synchronize(letters, letters.withColumn("value", F.upper("value")), "last")
    assert as_dict(got) == {c * 3: c.upper() * 5 for c in "abcdefghijklmnopqrstuvwxyz"}


# Indices


def test_index_follows_the_table(spark):
    schema = "employee_id long, name string, division_id long"
    before = spark.createDataFrame([(1, "A", 301), (2, "B", 301), (3, "C", 401), (4, "D", None), (5, "E", 401)], schema)
    after = spark.createDataFrame([(1, "A", 401), (3, "C", 401), (4, "D", 301), (5, "E", 401), (6, "F", 501)], schema)
    idx = index.build(before, "division_id", "employee_id")
    new = index.refresh(idx, before, after, "division_id", "employee_id")
    assert sorted(tuple(r) for r in new.collect()) == [(301, 4), (401, 1), (401, 3), (401, 5), (501, 6)]
    assert [r.pkey for r in index.get_values(new, 401, 2).collect()] == [1, 3]
    assert sorted(r.name for r in index.join_primary(new, after, "employee_id", spark.createDataFrame([(401,)], "ikey long")).collect()) == ["A", "C", "E"]
    assert [tuple(r) for r in index.jump(new, 401, 3, 2).collect()] == [(401, 3), (401, 5)]


def test_inverted_index(spark):
    docs = ["This is a pen.", "I am a boy.", "You are a girl.", "The pen is mine, boy.", None, ""]
    idx = index.build_inverted(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), "text", "doc_id")
    assert sorted(r.pkey for r in index.search_all(idx, ["PEN"]).collect()) == [0, 3]
    assert [r.pkey for r in index.search_all(idx, ["pen", "boy", "pen"]).collect()] == [3]
    assert sorted(r.pkey for r in index.search_any(idx, ["girl", "boy"]).collect()) == [1, 2, 3]


def test_words_of_other_letters_stay_whole(spark):
    docs = spark.createDataFrame([(0, "Für die Größe, FÜR uns."), (1, "L'été à Nîmes: e\u0301te\u0301 2024")], "doc_id long, text string")
    idx = index.build_inverted(docs, "text", "doc_id")
    assert [r.pkey for r in index.search_any(idx, ["für"]).collect()] == [0]
    assert [r.pkey for r in index.search_all(idx, ["Été", "nîmes", "e\u0301te\u0301"]).collect()] == [1]
    assert index.search_any(idx, ["f", "r", "gr", "t", "n", "te"]).count() == 0
    want = {"für": 2, "die": 1, "größe": 1, "uns": 1, "l": 1, "été": 1, "à": 1, "nîmes": 1, "e\u0301te\u0301": 1, "2024": 1}
    assert as_dict(reduce.word_count(docs, "text")) == want


# Logs, cache, shards


def test_update_log(spark):
    schema = "ts long, seq long, op string, server_id int, dbm_index int, key string, value string"
    log = [(10, 1, "SET", 0, 0, "one", "1"), (20, 2, "SET", 1, 0, "two", "2"), (30, 3, "REMOVE", 1, 0, "one", None), (40, 4, "CLEAR", 2, 1, None, None), (50, 5, "SET", 0, 1, "three", None)]
    frame, base = spark.createDataFrame(log, schema), kv(spark, [("old", "o")])
    assert as_dict(changelog.replay(base, frame)) == {"three": ""}
    assert as_dict(changelog.replay(base, frame, server_id=0)) == {"old": "o", "one": "1", "three": ""}
    assert as_dict(changelog.replay(base, frame, server_id=-2)) == {"old": "o", "two": "2", "three": ""}
    assert as_dict(changelog.replay(base, frame, dbm_index=0, min_timestamp=20)) == {"old": "o", "two": "2"}
    assert [r.status for r in changelog.apply_status(frame, server_id=1).orderBy("seq").collect()].count("INFEASIBLE_ERROR") == 3
    assert changelog.once_cleared(frame).count() == 4
    captured = changelog.capture(base, kv(spark, [("new", None), ("old", "p")])).collect()
    assert sorted((r.op, r.key, r.value) for r in captured) == [("SET", "new", None), ("SET", "old", "p")]
    assert [(r.op, r.key) for r in changelog.capture(base, base.limit(0)).collect()] == [("REMOVE", "old")]


def test_entries(spark):
    entries = [changelog.encode_entry("SET", 7, 300, b"key", b"v" * 200), changelog.encode_entry("REMOVE", 2**31 - 1, 0, b""), changelog.encode_entry("CLEAR", 0, 1)]
    broken = [None, b"", b"\xa1", b"\x00\x01\x02", entries[0][:-1], entries[0] + b"x", entries[1] + b"x", b"\xa1\x80\x80"]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(entries + broken)], "i int, m binary")
    got = df.select("i", changelog.parse_entries(F.col("m")).alias("e")).select("i", "e.*").orderBy("i").collect()
    assert (got[0].op, got[0].server_id, got[0].dbm_index, bytes(got[0].key), len(got[0].value)) == ("SET", 7, 300, b"key", 200)
    assert (got[1].op, got[1].server_id, bytes(got[1].key), got[1].value) == ("REMOVE", 2**31 - 1, b"", None)
    assert got[2].op == "CLEAR" and {r.status for r in got[3:]} == {"BROKEN_DATA_ERROR"}


@pytest.mark.parametrize("seed", range(3))
def test_lru_is_what_a_cache_holds(spark, seed):
    rnd = random.Random(seed)
    accesses = [(rnd.choices([rnd.randrange(300), rnd.randrange(10), None], [3, 2, 0.2])[0], i) for i in range(1500)]
    caches = defaultdict(lambda: cache.LRUCache(cache.slot_capacity(100, 8)))
    for k, i in accesses:
        if k is not None:
            caches[k % 8].add(k, i)
    got = cache.lru_retain(spark.createDataFrame(accesses, "k long, i long"), "k", "i", 100, F.pmod("k", F.lit(8)).cast("int"), 8)
    assert {(r.slot, r.k, r.last_seq) for r in got.collect()} == {(s, k, i) for s, c in caches.items() for k, i in c.items()}


def test_double_lru():
    c = cache.DoubleLRUCache(2, 3)
    for i in range(5):
        c.add(i, i)
    assert len(c) == 3 and c.get(0) is None and c.get(2) == 2 and c.get(3) == 3 and c.get(4) == 4
    c.add(9, 9)
    assert c.get(2) == 2 and c.get(9) == 9 and len(c) == 4


def test_shards(spark, tmp_path):
    df = kv(spark, [(f"k{i}", str(i)) for i in range(50)])
    path = f"{tmp_path}/s"
    shard.write_shards(df, path, 4)
    assert shard.count_shards(spark, path) == 4
    for i in (0, 17, 49):
        assert [r.value for r in shard.read_key(spark, path, f"k{i}", 4).collect()] == [str(i)]
    assert all(r.shard == shard.shard_number(r.key, 4) for r in shard.with_shard(df, 4).collect())
    assert [shard.bucket_count(n) for n in (0, 10, 100, 101, 102, 1000)] == [1, 10, 100, 101, 103, 1009]
    assert shard.should_rebuild({"file_bytes": 201, "live_bytes": 100}) and not shard.should_rebuild({"file_bytes": 200, "live_bytes": 100})
