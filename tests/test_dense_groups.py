"""Folds over dense groups: no array grows with the hits of a group."""

import random

from pyspark.sql import functions as F

from pulsegrid.operators import cluster as C
from pulsegrid.operators import stream_order as S


def test_counter_gaps_equal_a_fold(spark):
    r = random.Random(3)
    for low in (-4, 0):
        rows = [(i, r.randrange(60), r.choice([None, *range(low, 12)]), r.choice("ab")) for i in range(500)]
        expected = {}
        for k in "ab":
            last, ok, dropped, missed = None, 0, 0, 0
            for _, _, x, _ in sorted((x for x in rows if x[3] == k), key=lambda x: (x[1], x[0])):
                if x is not None and last is not None and (x == last or (x < last and x not in (0, 1))):
                    dropped += 1
                    continue
                missed += x - last - 1 if x is not None and last is not None and x > last + 1 else 0
                last, ok = x, ok + 1
            expected[k] = (ok, dropped, missed)
        df = spark.createDataFrame(rows, "seq long, time long, c long, k string")
        assert {x.k: (x.accepted, x.dropped, x.missed) for x in S.counter_gaps(df, ["k"], "c", ["time", "seq"]).collect()} == expected


def test_seeds_without_key_or_place(spark):
    rows = [(0, 1, 0, 0, None), (1, 2, 1, 1, None), (2, 3, None, 0, None), (3, 4, None, 0, None), (4, 5, 1, 0, 7)]
    df = spark.createDataFrame(rows, "seq long, time long, x int, y int, g int")
    assert {r.seq: r.seed for r in C.seed_clusters(df, ["g"], 3).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert {r.seq: r.seed for r in C.seed_clusters(df, ["g"], 0).collect()} == {i: i for i in range(5)}


def test_one_dense_group(spark):
    """All hits in one group: 300 000 on 400 pixels. Copying a growing array of hits does not end here."""
    df = spark.range(300_000).select(F.col("id").alias("seq"), F.col("id").alias("time"), (F.col("id") % 20).cast("int").alias("x"), (F.floor(F.col("id") / 20) % 20).cast("int").alias("y"), F.lit(1).alias("g"))
    seeds = C.seed_clusters(df, ["g"], 3)
    assert seeds.count() == 300_000 and seeds.where("seed >= 400").count() == 0
    row = S.counter_gaps(df.withColumn("c", F.col("seq") % 11), ["g"], "c", ["time"]).first()
    assert (row.accepted, row.dropped, row.missed) == (300_000, 0, 0)
    plan = S.counter_gaps(df, ["g"], "seq", ["time"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
