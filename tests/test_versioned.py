"""Versioned tables: changes between versions, failures, and exactly-once consumers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyweave.model import Status, StatusError
from keyweave.sources.versioned import VersionedTable, process_new

SCHEMA = "k long, v string"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_versions_and_changes(spark, table):
    assert table.version() == 0 and rows(table.read()) == Counter() and rows(table.changes(0)) == Counter()
    table.commit(frame(spark, [(i, "a") for i in range(10)]))
    table.commit(frame(spark, [(10, None), (10, None)]))
    gone = table.read(positions=True).filter("k IN (3, 4)")
    table.commit(frame(spark, [(3, "new")]), deleted=gone)
    assert table.version() == 3
    want = Counter([(i, "a") for i in range(10) if i not in (3, 4)] + [(10, None)] * 2 + [(3, "new")])
    assert rows(table.read()) == want
    assert rows(table.read(1)) == Counter((i, "a") for i in range(10))
    assert rows(table.changes(1, 2)) == Counter([(10, None, "insert")] * 2)
    assert rows(table.changes(2, 3)) == Counter([(3, "a", "delete"), (4, "a", "delete"), (3, "new", "insert")])
    assert rows(table.changes(0, 3)) == Counter({(*r, "insert"): n for r, n in want.items()})
    table.compact(1)
    assert rows(table.read()) == want and table.manifest().count() == 1
    assert rows(table.changes(3, 4, net=True)) == Counter()
    table.commit(frame(spark, [(99, "z")]), overwrite=True)
    assert rows(table.changes(4, net=True)) == Counter({(*r, "delete"): n for r, n in want.items()}) + Counter([(99, "z", "insert")])


def test_lost_race_changes_nothing(spark, table):
    table.commit(frame(spark, [(1, "a")]))
    with pytest.raises(StatusError) as e:
        table.commit(frame(spark, [(2, "b")]), expect=0)
    assert e.value.status == Status.PRECONDITION
    with pytest.raises(StatusError):
        table._publish(1, "late", "{}")
    assert rows(table.read()) == Counter([(1, "a")])


def test_consumer_survives_failures(spark, tmp_path, table):
    sink = VersionedTable(spark, f"file://{tmp_path}/out", "k long, v string, change string")
    assert process_new(table, sink, "c", lambda d: d) is None
    table.commit(frame(spark, [(1, "a"), (2, "b")]))
    with pytest.raises(ZeroDivisionError):
        process_new(table, sink, "c", lambda d: 1 / 0)

    def breaks(d):
        return d.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        process_new(table, sink, "c", breaks)
    assert sink.version() == 0
    assert process_new(table, sink, "c", lambda d: d) == (0, 1)
    assert process_new(table, sink, "c", lambda d: d) is None
    table.commit(deleted=table.read(positions=True).filter("k = 1"))
    table.commit(frame(spark, [(3, "c")]))
    assert process_new(table, sink, "c", lambda d: d) == (1, 3)
    assert rows(sink.read()) == Counter([(1, "a", "insert"), (2, "b", "insert"), (1, "a", "delete"), (3, "c", "insert")])
    assert process_new(table, sink, "other", lambda d: d.limit(0)) == (0, 3)
    assert sink.properties() == {"processed.c": "3", "processed.other": "3"}


def test_many_commits_merge_their_manifests(spark, tmp_path, monkeypatch):
    from keyweave.sources import versioned

    monkeypatch.setattr(versioned, "MERGE_PARTS", 4)
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ordered_by=["k"])
    for i in range(4):
        t.commit(frame(spark, [(10 * i + j, "a") for j in range(10)]))
        t.commit(deleted=t.read(positions=True).filter(F.col("k") == 10 * i))
    want = Counter((i, "a") for i in range(40) if i % 10)
    assert rows(t.read()) == want and len(t._entry(8)["files"]) <= 4
    assert rows(t.read(3)) == Counter((i, "a") for i in range(1, 20))
    assert rows(t.changes(5, 6)) == Counter([(20, "a", "delete")]) and rows(t.changes(6, 8)) == Counter((i, "a", "insert") for i in range(31, 40))
    ends = [(r.lo.k, r.hi.k) for r in t.entries().collect()]
    assert min(ends)[0] == 0 and max(ends)[1] == 39
    near = t.entries().filter("hi.k >= 35")
    assert {r.k for r in t.read(files=near).collect()} <= set(range(30, 40))
    data = lambda df: [f for f in df.inputFiles() if "/data/" in f]
    assert len(data(t.read(files=near))) < len(data(t.read()))


def test_compaction_of_worn_files(spark, table):
    table.commit(frame(spark, [(i, "a") for i in range(10)]).coalesce(1))
    table.commit(frame(spark, [(i, "b") for i in range(10)]).coalesce(1))
    table.commit(deleted=table.read(positions=True).filter("v = 'a' AND k < 8"))
    before = {r.file for r in table.manifest().collect()}
    table.compact(1, least_dead=0.5)
    after = {r.file for r in table.manifest().collect()}
    assert len(before & after) == 1 and len(after) == 2
    assert rows(table.read()) == Counter([(8, "a"), (9, "a")] + [(i, "b") for i in range(10)])
    assert rows(table.changes(3, net=True)) == Counter()
