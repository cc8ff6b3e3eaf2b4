"""Most frequent values against a plain count."""

import random
from collections import Counter

import oracle
import pytest

from keyweave.llm.frequent import first_bits, most_frequent, next_bits


def brute(values, k):
    c = Counter(v for v in values if v is not None)
    best = sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
    return [(v, n, i + 1) for i, (v, n) in enumerate(best)]


def run(spark, values, k, **kw):
    df = spark.createDataFrame([(v, 1, "x") for v in values], "v string, n int, h string")
    return sorted((tuple(r) for r in most_frequent(df, "v", k, **kw).collect()), key=lambda r: r[2])


@pytest.mark.parametrize("counters", [4, 64, 1 << 22])
@pytest.mark.parametrize("shape", ["skewed", "flat", "third"])
def test_top(spark, counters, shape):
    rnd = random.Random(len(shape))
    if shape == "skewed":
        values = [f"k{int(rnd.paretovariate(0.8))}" for _ in range(3000)]
    elif shape == "flat":
        values = [f"k{i}" for i in range(900)] * 2
    else:
        values = ["hot"] * 1000 + [f"k{rnd.randrange(1500)}" for _ in range(2000)]
    values += [None] * 500 + ["", "x" * 10_000, "ü"] * 3
    rnd.shuffle(values)
    assert run(spark, values, 10, counters=counters, beam_per_value=1) == brute(values, 10)


def test_few_and_none(spark):
    assert run(spark, ["a", "b", "a", None], 5) == [("a", 2, 1), ("b", 1, 2)]
    assert run(spark, [None], 5) == []
    assert run(spark, [], 5) == []


def test_rounds_stay_within_the_counters():
    assert first_bits(4_000_000) == 12 and first_bits(10**11) == 22 and first_bits(0) == 1
    for rows in (10**4, 10**8, 10**11):
        bits = first_bits(rows)
        for kept in (10, 10**4, 10**6):
            at, rounds = bits, 0
            while (longer := next_bits(at, kept, rows)) is not None:
                assert longer > at and (kept << (longer - at) <= 1 << 22 or longer == at + 4)
                at, rounds = longer, rounds + 1
            assert rounds <= 4 and kept * rows / 2**at <= 1 << 22


@pytest.mark.parametrize("name", ["p2_found", "p2_top"])
def test_sql(spark, sf, name):
    assert oracle.check(spark, name, sf) == 25
