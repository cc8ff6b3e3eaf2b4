"""Offset chunking against a plain pass over the sorted rows."""

import random
from itertools import groupby

import oracle
import pandas as pd
import pytest

from keyweave.operators.chunking import apply_chunks, chunk_keys, heavy_keys, ordered_profile

SCHEMA = "k string, d int, o long, v string, block string, chunk int, __chunk0 string"


def make(seed, n=600):
    rnd = random.Random(seed)
    orders = rnd.sample(range(n * 50) if seed % 2 else [x**3 for x in range(n * 2)], n)
    pick = lambda: rnd.choices(["hot", "warm", None, ""], [6, 2, 1, 1])[0]
    return [(pick(), rnd.choice([0, None]), o, rnd.choice(["a", "b", None]), "clash", 1, None) for o in orders]


def expected(rows):
    out = []
    order = lambda r: (str(r[0]), str(r[1]), r[2])
    for (k, d), group in groupby(sorted(rows, key=order), key=lambda r: (r[0], r[1])):
        g = list(group)
        switches = sum(x[3] != y[3] for x, y in zip(g, g[1:]))
        out.append((k, d, len(g), g[0][2], g[-1][2], g[-1][3], switches))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk,block", [(7, 13), (50, 100), (10_000, 5), (1, 600)])
def test_profile(spark, seed, chunk, block):
    rows = make(seed)
    got = ordered_profile(spark.createDataFrame(rows, SCHEMA), ["k", "d"], "o", "v", chunk_rows=chunk, block_rows=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_chunks_are_equal_and_ordered(spark):
    df = chunk_keys(spark.createDataFrame(make(1), SCHEMA), ["k"], "o", chunk_rows=20, block_rows=30)
    assert df.columns == ["k", "d", "o", "v", "block", "chunk", "__chunk0", "__chunk"]
    by = {}
    for r in df.collect():
        by.setdefault(r.k, {}).setdefault(r["__chunk"], []).append(r.o)
    for chunks in by.values():
        ids = sorted(chunks)
        assert ids == list(range(len(ids)))
        assert all(len(chunks[i]) == 20 for i in ids[:-1]) and len(chunks[ids[-1]]) <= 20
        assert all(max(chunks[a]) < min(chunks[b]) for a, b in zip(ids, ids[1:]))


def test_apply_chunks_merges_user_states(spark):
    rows = make(2)
    df = chunk_keys(spark.createDataFrame(rows, SCHEMA).select("k", "o"), ["k"], "o", chunk_rows=25, block_rows=40)

    def state(pdf):
        assert len(pdf) <= 25
        return pd.DataFrame({"k": pdf.k[:1], "__chunk": pdf["__chunk"][:1], "s": [pdf.o.sum()]})

    got = {r.k: r.s for r in apply_chunks(df, ["k"], state, "k string, __chunk long, s long").groupBy("k").agg({"s": "sum"}).toDF("k", "s").collect()}
    want = {}
    for r in rows:
        want[r[0]] = want.get(r[0], 0) + r[2]
    assert got == want


def test_heavy_keys_and_empty(spark):
    rows = make(0)
    got = heavy_keys(spark.createDataFrame(rows, SCHEMA), ["k"], "o", 0.15, chunk_rows=50, block_rows=60).collect()
    want = {k: sum(r[0] == k for r in rows) for k in {r[0] for r in rows}}
    assert {r.k: r.n for r in got} == {k: n for k, n in want.items() if n > 0.15 * len(rows)}
    none = spark.createDataFrame([], SCHEMA)
    assert ordered_profile(none, ["k"], "o", "v").collect() == []
    assert heavy_keys(none, ["k"], "o", 0.1).collect() == []


@pytest.mark.parametrize("name", ["p5_found", "p5_profile"])
def test_sql(spark, sf, name):
    assert oracle.check(spark, name, sf) > 0
