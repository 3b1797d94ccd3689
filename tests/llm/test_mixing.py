"""Mixing: targets by water filling, exact quotas of the splitting tree, near targets, fixed draws."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from mnemoscope.llm import mixing
from mnemoscope.llm.queries import op4
from tests.llm import cases


def targets(sizes):
    """{source: size} to {source: target} by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, got = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in got]
        rest = total - sum(got.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return got | share
        got |= {s: 3.0 * sizes[s] for s in over}


def corpus(spark, seed=1, n=300):
    rng = random.Random(seed)
    names = ["hot"] * 10 + ["b", "c", "d", "é", None, "tiny"]
    rows = []
    for i in range(n):
        source = rng.choice(names)
        rows.append((i, cases.prose(rng, rng.randrange(1, 5 if source == "tiny" else 60)), "en", source, 0, None, None, 0))
    return cases.awkward(spark).unionByName(spark.createDataFrame(rows, cases.SCHEMA))


def test_targets_and_taken(spark):
    docs = corpus(spark)
    plan = mixing.plan_mix(docs, shards=5, block_words=300).collect()
    assert len(plan) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = {("1" if s is None else "0" + s): (sizes[s], t) for s, t in targets(sizes).items()}
    taken, largest = Counter(), Counter()
    for r in plan:
        largest[r.source_key] = max(largest[r.source_key], r.size)
        assert r.source_size == want[r.source_key][0] and abs(r.target - want[r.source_key][1]) < 1e-6 * (1 + r.target)
        assert len(r.draws) <= 3
        taken[r.source_key] += r.size * len(r.draws)
    for key, (_, target) in want.items():
        assert abs(taken[key] - target) <= max(30, 0.02 * target, largest[key] / 2), (key, taken[key], target)
    again = mixing.plan_mix(docs, shards=5, block_words=300).collect()
    assert sorted(map(repr, plan)) == sorted(map(repr, again))


def test_tree_keeps_quotas_and_balances(spark):
    quotas = {"a": 1000, "b": 300, "c": 7, "d": 0}
    frame = spark.createDataFrame(list(quotas.items()), "source_key string, draws bigint")
    got = mixing.split_quotas(frame, 6, seed=2).collect()
    per_source, per_shard = Counter(), Counter()
    for r in got:
        per_source[r.source_key] += r.draws
        per_shard[r.shard] += r.draws
    assert per_source == Counter({k: v for k, v in quotas.items() if v})
    assert max(per_shard.values()) - min(per_shard.values()) <= 3 and len(per_shard) == 6


def test_shares_are_hypergeometric(spark):
    """The left half of 10 + 30 draws holds 5 of the first kind on average, with the right variance."""
    frame = spark.createDataFrame([("a", 10), ("b", 30)], "source_key string, draws bigint")
    first = [sum(r.draws for r in mixing.split_quotas(frame, 2, seed=s).filter("shard = 0 AND source_key = 'a'").collect()) for s in range(40)]
    assert abs(np.mean(first) - 5) < 0.9 and 0.4 < np.var(first) < 4.5


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = corpus(spark, 3, 120)
    mixed = mixing.mix(docs, shards=4, block_words=200)
    assert mixed.columns == docs.columns
    draws = {(r.doc_id, r.source_key): len(r.draws) for r in mixing.plan_mix(docs, shards=4, block_words=200).collect()}
    key = lambda r: (r.doc_id, "1" if r.source is None else "0" + r.source)
    want = sum(draws[key(r)] for r in docs.collect())
    rows = mixed.collect()
    assert len(rows) == want
    assert mixing.mix(cases.empty(spark)).count() == 0 and mixing.plan_mix(cases.empty(spark)).count() == 0


def test_query_uses_no_python(spark):
    if not cases.has_tables():
        return
    got = op4(spark, cases.FOLDER)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got.agg(F.max(F.expr("taken - 3 * size"))).first()[0] <= 0
