"""Every query against its SQL, and the entry points."""

import oracle
import pytest

import __spark_entry__ as entry

#: Checked beside their operators, or slow and checked at a larger scale by the driver.
ELSEWHERE = ("p1_", "p2_", "p3_", "p4_", "p5_", "p6_", "p7_", "p8_")
NAMES = [n for n in entry.queries() if not n.startswith(ELSEWHERE)]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    if name in entry.oracle_sql():
        oracle.check(spark, name, sf)
    else:
        assert entry.queries()[name](spark, sf).count() > 0


def test_far_index(spark, monkeypatch):
    from pyspark.sql import functions as F

    from keyweave.operators import point

    monkeypatch.setattr(point, "TOP_ROWS", 0)
    df = spark.range(1000).select(F.format_string("k%04d", (F.col("id") * 7) % 1000).alias("key"), F.col("id").alias("value"))
    for i in (0, 1, 499, 999):
        assert [r.key for r in point.get_by_index(df, i).collect()] == [f"k{i:04d}"]
    assert point.get_by_index(df, 1000).collect() == [] and point.get_by_index(df.limit(0), 0).collect() == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    core = [m.__name__ for m in entry._CORE]
    assert not any("llm" in m for m in core)


def test_key_batches_are_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    orders, asked, events = (
        {r[0] for r in spark.read.parquet(f"{sf}/{t}.parquet").selectExpr(c).collect()}
        for t, c in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "event_id * 7"))
    )
    assert {r.key for r in entry.queries()["get_multi"](spark, sf).collect()} == orders & asked
    assert {r.key for r in entry.queries()["remove_multi"](spark, sf).collect()} == orders - asked - events


def test_rekey_runs_over_growing_tables(spark):
    at = {sf: entry.queries()["rekey_status"](spark, f"/root/testdata/{sf}").groupBy("status").count().collect() for sf in ("sf0.001", "sf0.01")}
    small, large = ({r.status: r["count"] for r in rows} for rows in at.values())
    assert set(small) == {"SUCCESS", "DUPLICATION_ERROR", "NOT_FOUND_ERROR"} and all(large[s] > 5 * n for s, n in small.items())


def test_whole_tables():
    import inspect

    from keyweave.plans import record_queries

    code = inspect.getsource(record_queries)
    assert "rlike" not in code and ".limit(" not in code and "l_quantity" not in code
