"""Physical plans: what reaches the scan, what is bounded, what combines before a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keyweave.operators import point, reduce, scan, search


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    spark.range(2000).select(F.format_string("k%05d", "id").alias("key"), F.col("id").cast("string").alias("value"), F.lit("unused").alias("other")).write.parquet(path)
    return spark.read.parquet(path)


def test_predicates_reach_the_scan(stored):
    assert "EqualTo(key,k00007)" in plan(point.get(stored, "k00007"))
    assert "StringStartsWith(key,k01)" in plan(search.search(stored, "begin", "k01").select("key"))
    assert "StringContains(key,9)" in plan(search.search(stored, "contain", "9").select("key"))
    p = plan(scan.range_scan(stored, "upper", "k01000", 5).select("key"))
    assert "GreaterThan(key,k01000)" in p and re.search(r"TakeOrderedAndProject|TopK", p)
    assert "other" not in plan(point.get_multi(stored, stored.select("key").limit(3))).split("ReadSchema")[1].split("\n")[0]


def test_edit_distance_is_a_bounded_top_k(stored):
    p = plan(search.search(stored, "edit", "k00007", 3).select("key", "distance"))
    assert "TakeOrderedAndProject" in p and "Python" not in p


def test_reducers_combine_before_the_shuffle(stored):
    rows = reduce.merge_runs(stored.select("key", "value"))
    for name in ("last", "total", "first"):
        p = plan(reduce.reduce_rows(rows, name))
        assert "partial_" in p and "Python" not in p


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p5_found", "changelog_replay", "lru_retain", "wordcount", "merge_last", "compare_exchange"])
def test_no_python_no_cross_join(spark, sf, name):
    p = plan(entry.queries()[name](spark, sf))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoop|EvalPython|InPandas", p)


def test_lru_limits_groups_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(entry.queries()["lru_retain"](spark, sf))


def test_only_needed_columns_are_read(spark, sf):
    p = plan(entry.queries()["p3_found"](spark, sf))
    assert "message" not in "".join(re.findall(r"ReadSchema: (.*)", p))
    p = plan(entry.queries()["p1_found"](spark, sf))
    assert "rec_value" not in "".join(re.findall(r"ReadSchema: (.*)", p))
