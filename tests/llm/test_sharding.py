import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import sharding
from pulsegrid.llm.sharding import communication_matrix, hypergeometric, op5_uniform_shards, shard_rows
from tests.llm.fixtures import awkward, empty, rows


def check(found, n):
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == n
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_whole_table(spark, sf_dir):
    found = op5_uniform_shards(spark, sf_dir).collect()
    check(found, len(docs := dict(rows(spark, sf_dir))))
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs.items()}


def test_awkward(spark):
    df = awkward(spark).drop("shard")
    out = shard_rows(df, shards=3)
    check(out.collect(), df.count())
    assert set(df.columns) < set(out.columns)
    assert shard_rows(empty(spark)).collect() == []


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "a", 1) for i in range(30)], "doc_id long, `_start` string, `odd.name` int")
    for name in ("shard", "slot", "_key", "_cell", "_rank", "_place", "row"):
        df = df.withColumn(name, F.lit("mine"))
    out = shard_rows(df, shards=3)
    found = out.collect()
    check(found, 30)
    assert set(out.columns) == set(df.columns)
    assert all(r["_key"] == r["_cell"] == r["_rank"] == r["_place"] == r["row"] == "mine" and r["_start"] == "a" and r["odd.name"] == 1 for r in found)


def test_beyond_a_thousand_million_rows():
    m = communication_matrix([3_000_000_000, 2_500_000_001, 7], 8, 1)
    assert m.sum(axis=1).tolist() == [3_000_000_000, 2_500_000_001, 7] and m.sum() == 5_500_000_008
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()


def test_large_draws_follow_the_law():
    """The rejection method against the exact law, on small numbers, and its mean and spread on large ones."""
    rng, law = np.random.default_rng(3), Counter()
    for _ in range(20_000):
        law[_rejected(rng, 12, 20, 9)] += 1
    exact = {x: math.comb(12, x) * math.comb(20, 9 - x) / math.comb(32, 9) for x in range(10)}
    assert sum((law[x] - 20_000 * q) ** 2 / (20_000 * q) for x, q in exact.items()) < 30  # 9 degrees of freedom
    good, bad, n = 3 * 10**9, 7 * 10**9, 10**9
    drawn = np.array([hypergeometric(rng, good, bad, n) for _ in range(3000)], dtype=float)
    spread = math.sqrt(n * 0.3 * 0.7 * (good + bad - n) / (good + bad - 1))
    assert abs(drawn.mean() - 3 * 10**8) < 4 * spread / 3000**0.5 and drawn.std() == np.clip(drawn.std(), 0.95 * spread, 1.05 * spread)


def _rejected(rng, good, bad, drawn):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sharding, "EASY", 0)
        return hypergeometric(rng, good, bad, drawn)


def test_matrix_is_exact_and_unbiased():
    total = np.zeros((4, 8))
    for seed in range(300):
        m = communication_matrix([100, 1, 0, 59], 8, seed)
        assert m.sum(axis=1).tolist() == [100, 1, 0, 59] and m.sum(axis=0).tolist() == [20] * 8
        total += m
    assert abs(total[0] / 300 - 12.5).max() < 0.8


def test_uniform(spark):
    df = spark.range(4000, numPartitions=7).repartition(5)
    counts = Counter()
    for seed in range(4):
        for r in shard_rows(df, seed=seed, cell_rows=50).where("id < 400").select("shard", F.floor(F.col("slot") / 125).alias("quarter")).collect():
            counts[r.shard, r.quarter] += 1
    expected = 1600 / 32
    assert sum((counts[s, q] - expected) ** 2 / expected for s in range(8) for q in range(4)) < 70  # 31 degrees of freedom
