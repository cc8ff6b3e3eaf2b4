"""Packing invariants, fill against the least possible number of containers, and token counts."""

import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from keyweave.llm.packing import assign, bin_report, pack
from keyweave.llm.queries import QUERIES
from keyweave.llm.tokens import token_count

SCHEMA = "doc_id long, n_tokens long, bin string, shard int, size string"


def brute_assign(sizes, capacity, attention):
    n = max(1, -(-sum(sizes) // capacity))
    bins, out = [[] for _ in range(n)], []
    for s in sizes:
        cost = lambda b: sum(x + attention * x * x for x in b)
        fits = [i for i, b in enumerate(bins) if sum(b) + s <= capacity]
        if fits:
            j = min(fits, key=lambda i: (cost(bins[i]), i))
        else:
            bins.append([])
            j = len(bins) - 1
        bins[j].append(s)
        out.append(j)
    names = {b: i for i, b in enumerate(sorted(set(out)))}
    return [names[b] for b in out]


@pytest.mark.parametrize("seed", range(5))
def test_assign_is_lowest_cost_first(seed):
    rnd = random.Random(seed)
    sizes = sorted((rnd.choice([1, 4, 16, 64]) * rnd.randrange(1, 9) for _ in range(60)), reverse=True)
    sizes = [min(s, 512) for s in sizes]
    assert assign(np.array(sizes), 512, 1 / 512).tolist() == brute_assign(sizes, 512, 1 / 512)


@pytest.mark.parametrize("shard_items", [50, 10_000])
def test_pack(spark, shard_items):
    rnd = random.Random(1)
    docs = [(i, rnd.choice([None, 0, 1, 30, 100, rnd.randrange(1, 256), 256, 257, 700]), "clash", 1, None) for i in range(400)]
    docs += docs[:20] + [(None, 5, None, None, None)]
    rows = pack(spark.createDataFrame(docs, SCHEMA), "doc_id", "n_tokens", 256, shard_items=shard_items).collect()
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r.n_tokens)
        assert r.n_pieces == 1 or r.n_tokens == 256 or r.piece == r.n_pieces - 1
    assert max(map(sum, bins.values())) <= 256
    want = {}
    for i, n, *_ in docs:
        want.setdefault(i, []).append(n or 0)
    for i, sizes in want.items():
        mine = [r for r in rows if r.doc_id == i]
        assert sum(r.n_tokens for r in mine) == sum(sizes)
        assert len(mine) == sum(max(1, -(-s // 256)) for s in sizes)
        assert {r.start for r in mine} == {p * 256 for s in sizes for p in range(max(1, -(-s // 256)))}


def test_little_space_is_left(spark):
    rnd = np.random.default_rng(3)
    docs = [(i, int(n), None, None, None) for i, n in enumerate(np.clip(rnd.lognormal(5.5, 0.8, 4000), 1, 4000))]
    packed = pack(spark.createDataFrame(docs, SCHEMA), "doc_id", "n_tokens", 2048)
    least = -(-sum(d[1] for d in docs) // 2048)
    report = bin_report(packed, 2048).collect()
    assert len(report) <= 1.01 * least + 1
    assert all(r.unused == 2048 - r.n_tokens >= 0 for r in report)


def test_repeated_rows_spread_over_the_shards(spark):
    docs = [(None, 16, None, None, None)] * 4000
    packed = pack(spark.createDataFrame(docs, SCHEMA), "doc_id", "n_tokens", 64, shard_items=200).collect()
    per = [sum(r.shard == s for r in packed) for s in range(20)]
    assert len(packed) == 4000 and max(per) < 300 and min(per) > 100


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pack(none, "doc_id", "n_tokens", 10).collect() == []
    with pytest.raises(ValueError):
        pack(none, "doc_id", "n_tokens", 0)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_count(spark, name):
    texts = ["", None, "Hello world", "<|endoftext|>", "ab " * 20_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"), name)).collect()]
    assert got[:2] == [0, 0] and got[2] in (2, 3) and got[3] > 2 and got[4] >= 20_000


def test_found_are_the_documents_above_capacity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", token_count(F.col("text"), "piece_bpe_32k.model").alias("n"))
    want = {r.doc_id for r in docs.filter("n > 2048").collect()}
    got = [r.doc_id for r in QUERIES["p6_found"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_sql(spark, sf):
    assert oracle.check(spark, "p6_checks", sf) == 1
