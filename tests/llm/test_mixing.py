"""Mixes against the Pfair bound and the plain amounts."""

import random
from collections import Counter

import oracle
import pytest
from pyspark.sql import functions as F

from keyweave.llm.mixing import mix, pfair_slots, slot_weights, source_key
from keyweave.llm.queries import QUERIES

DOCS = "doc_id long, source string, n_tokens long, k string, slot int, name string"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("blocks", [[1], [3, 5, 2], [100, 1, 1], [0, 4, 0, 9], [13, 18, 15, 20, 10, 12, 8, 2, 2], []])
def test_less_than_one_block_from_the_weight(blocks):
    slots, total = pfair_slots(blocks), sum(blocks)
    assert sorted(t for own in slots for t in own) == list(range(total))
    for own, b in zip(slots, blocks):
        assert own == sorted(own) and len(own) == b
        for t in range(1, total + 1):
            done = sum(x < t for x in own)
            assert abs(done - b * t / total) < 1


def make(spark, seed=0):
    rnd = random.Random(seed)
    docs = []
    for i in range(900):
        s = rnd.choices(["big", "mid", "small", "Other Kind", None, "not there"], [60, 20, 5, 10, 3, 2])[0]
        spell = rnd.choice([s, s and s.upper(), s and f" {s} ", s and s.replace(" ", "-")])
        docs.append((i, spell, rnd.choice([None, 0, 1, 50, 200, rnd.randrange(1, 900)]), "clash", 1, None))
    targets = [("big", 0.3, 1), ("mid", 0.3, 3), ("small", 0.2, 2), ("other_kind", 0.15, 1), ("missing", 0.05, 4)]
    return docs, targets, spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)


@pytest.mark.parametrize("bucket_rows,block", [(20, 300), (10_000, 2_000)])
def test_mix(spark, bucket_rows, block):
    docs, targets, d, t = make(spark)
    out = mix(d, t, bucket_rows=bucket_rows, block_tokens=block)
    key = lambda s: s and s.strip().lower().replace(" ", "_").replace("-", "_")
    size = Counter()
    for _, s, n, *_ in docs:
        size[key(s)] += n or 0
    total = sum(size[s] for s, *_ in targets)
    rows, report = out.rows.collect(), {r.source: r for r in out.report.collect()}
    tokens, longest = Counter(), max(n or 0 for _, _, n, *_ in docs)
    uses = Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
        uses[r.source, r.doc_id, r.copy] += 1
    assert max(uses.values()) == 1
    for s, share, repeats in targets:
        r = report[s]
        assert r.short == (size[s] * repeats < share * total) and r.size == size[s]
        assert max([x.copy + 1 for x in rows if x.source == s], default=0) <= repeats
        amount = min(share * total, size[s] * repeats)
        assert amount - 1 <= tokens[s] < amount + longest + 1
        assert r.tokens == tokens[s] and r.actual_share == pytest.approx(tokens[s] / sum(tokens.values()))
    # every block lies in its window, so each source is less than a block from its weight while it lasts
    weights = dict(zip(sorted(t[0] for t in targets), slot_weights([t[1] for t in sorted(targets)])))
    period = sum(weights.values())
    for r in rows:
        a, i = weights[r.source], min(r.pos, max(0, int(min(report[r.source].wanted, report[r.source].supply)) - 1)) // block
        assert i * period // a <= r.slot < -(-(i + 1) * period // a)


def test_weights():
    assert slot_weights([0.13, 0.18, 0.69]) == [13, 18, 69] and slot_weights([0.5, 0, 0.5]) == [1, 0, 1]
    assert slot_weights([1 / 3, 2 / 3], 30) == [1, 2] and slot_weights([]) == [] and slot_weights([0.0]) == [0]
    thirds = slot_weights([1 / 7, 2 / 7, 4 / 7], 1000)
    assert sum(thirds) == 1000 and thirds == [143, 286, 571] and slot_weights([1e-9, 1.0])[0] == 1


def test_repeated_rows_and_null_ids(spark):
    docs = [(None, "a", 3, "", 0, "")] * 500 + [(7, "a", 5, "", 0, "")] * 3 + [(8, "b", 2000, "", 0, "")]
    out = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS), block_tokens=100)
    rows = out.rows.collect()
    whole = [r for r in rows if r.source == "a" and r.copy == 0]
    assert len(whole) == 503 and sorted(r.pos for r in whole)[:2] != [0, 0] and len({r.pos for r in whole}) == 503
    assert len({r.slot for r in rows if r.source == "a"}) >= 17


def test_empty(spark):
    _, targets, d, t = make(spark)
    none = mix(d.limit(0), t)
    assert none.rows.collect() == [] and {r.tokens for r in none.report.collect()} == {0}
    assert mix(d, t.limit(0)).report.collect() == []


def test_source_key(spark):
    said = ["plenary_record", " Plenary Record", "PLENARY-RECORD", "plenary  record ", None, ""]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(source_key(F.col("s"))).collect()]
    assert got == ["plenary_record"] * 4 + [None, ""]


def test_found(spark, sf):
    got = {r.source for r in QUERIES["p7_found"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("source", "length(text) as n_tokens").collect()
    size = Counter()
    for r in docs:
        if r.source:
            size[r.source.strip().lower().replace(" ", "_").replace("-", "_")] += r.n_tokens
    goal = spark.read.parquet(f"{sf}/mix_targets.parquet").collect()
    total = sum(size[g.source] for g in goal)
    assert got == {g.source for g in goal if size[g.source] * g.max_repeats < g.target_share * total}


def test_sql(spark, sf):
    assert oracle.check(spark, "p7_checks", sf) == 9 and oracle.check(spark, "p7_found", sf) > 0
