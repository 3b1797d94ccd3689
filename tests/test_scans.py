"""Ordered scans, quantiles and joins with one hot key, against brute force."""

import math
import random

from pyspark.sql import functions as F

from mnemoscope.operators.joins import lookup_join
from mnemoscope.operators.quantiles import distribution
from mnemoscope.operators.scans import BLOCK, position_blocks, range_blocks, running


def skewed(spark, n=3000):
    random.seed(5)
    rows = [("hot" if random.random() < 0.5 else f"k{random.randrange(20)}", i, random.choice([None, random.randrange(100)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, seq int, v int")


def brute(rows):
    state, out = {}, {}
    for key, seq, v in sorted(rows, key=lambda r: (r[0], r[1])):
        rank, total, top, last = state.get(key, (0, None, None, None))
        rank += 1
        total = total if v is None else (total or 0) + v
        top = v if top is None else top if v is None else max(top, v)
        out[key, seq] = (rank, total, top, last)
        state[key] = (rank, total, top, v)
    return out


def check(frame, rows):
    got = {(r.key, r.seq): (r.rank, r.total, r.top, r.last) for r in frame.collect()}
    assert got == brute(rows)


def test_range_blocks_split_a_hot_key_and_lose_nothing(spark):
    rows, frame = skewed(spark)
    blocks = range_blocks(frame, ["key"], ["seq"], parts=8)
    sizes = [r["count"] for r in blocks.groupBy(BLOCK).count().collect()]
    assert max(sizes) < len(rows) / 3 and blocks.filter("key = 'hot'").select(BLOCK).distinct().count() > 2
    check(running(blocks, ["key"], ["seq"], rank="rank", sums={"total": "v"}, maxes={"top": "v"}, lags={"last": "v"}), rows)


def test_position_blocks_give_the_same(spark):
    rows, frame = skewed(spark)
    blocks = position_blocks(frame, "seq", size=100)
    check(running(blocks, ["key"], ["seq"], rank="rank", sums={"total": "v"}, maxes={"top": "v"}, lags={"last": "v"}), rows)


def test_quantiles_are_exact_for_skewed_and_odd_values(spark):
    random.seed(7)
    groups = {
        "hot": [random.lognormvariate(3, 2) for _ in range(4000)], "same": [5.25] * 500, "one": [-3.0], "mixed": [random.uniform(-1e6, 1e6) for _ in range(300)],
        "near": [1000 + i * 1e-9 for i in range(1000)], "tiny": [i * 1e-12 for i in range(100)], "outlier": [1e300, *map(float, range(50))], "empty": []}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("empty", None)]
    result = {r.g: r for r in distribution(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for name, values in groups.items():
        ordered = sorted(values)
        want = [ordered[math.ceil(len(ordered) * p) - 1] for p in (0.5, 0.95)] if ordered else [None, None]
        assert [result[name].p50, result[name].p95] == want, name
        assert result[name]["count"] == len(ordered)


def test_small_counts_match_nearest_rank(spark):
    rows = [(n, i) for n in range(1, 61) for i in range(1, n + 1)]
    result = {r.g: r for r in distribution(spark.createDataFrame(rows, "g int, v int"), ["g"], "v").collect()}
    assert all(result[n].p50 == math.ceil(n * 0.5) and result[n].p95 == math.ceil(n * 0.95) for n in range(1, 61))


def test_salted_lookup_equals_broadcast_lookup(spark):
    rows, frame = skewed(spark)
    lookup = frame.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key <> 'k3'")
    small = lookup_join(frame, lookup, ["key"], "left", spread=["seq"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = lookup_join(frame, lookup, ["key"], "left", spread=["seq"])
        assert sorted(map(tuple, salted.select("key", "seq", "v", "n").collect()), key=str) == sorted(
            map(tuple, small.select("key", "seq", "v", "n").collect()), key=str)
        assert lookup_join(frame, lookup, ["key"], "left_anti", spread=["seq"]).count() == sum(r[0] == "k3" for r in rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
