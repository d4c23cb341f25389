"""Golden cases of clustering and matching, and windows against a plain fold on random data."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import cluster as C
from pulsegrid.operators import match as M
from pulsegrid.operators import stream_order as S


def frame(spark, rows, schema="seq long, time long, coordinate int, weight int, plane int, module string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("step,gap,clusters", [(1, 0, 10), (5, 5, 1), (6, 5, 10)])
def test_gap_is_strict(spark, step, gap, clusters):
    rows = [(i, step * (i + 1), 1, 1, 0, "m") for i in range(10)]
    assert C.time_clusters(frame(spark, rows), ["module", "plane"], gap).select("time_cluster").distinct().count() == clusters


@pytest.mark.parametrize("width", [None, 7, 100])
def test_islands_equal_a_fold(spark, width):
    r = random.Random(2)
    rows = [(i, s := r.randrange(600), s + r.randrange(30), r.choice("ab")) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, s long, e long, k string")
    found = {x.seq: x.island for x in C.islands(df, ["k"], "s", 2, end="e", order=["seq"], width=width).collect()}
    expected = {}
    for k in "ab":
        reach, start = None, None
        for seq, s, e, _ in sorted((x for x in rows if x[3] == k), key=lambda x: (x[1], x[0])):
            if reach is None or s - reach > 2:
                start = s
            reach = e if reach is None else max(reach, e)
            expected[seq] = start
    assert found == expected


def test_time_gap_and_overlap(spark):
    row = spark.range(1).select(*(f(F.lit(a), F.lit(b), F.lit(c), F.lit(d)) for f, a, b, c, d in ((C.time_gap, 0, 0, 1, 1), (C.time_gap, 0, 0, 0, 0), (C.time_overlap, 0, 5, 3, 9), (C.time_overlap, 0, 2, 3, 9)))).first()
    assert tuple(row) == (1, 0, 3, 0)


def test_seed_clusters_measure_from_the_seed(spark):
    """0, 2, 4 with gap 3: 4 is near 2 but not near the seed 0."""
    rows = [(i, 10, x, 0) for i, x in enumerate((0, 2, 4, 5))]
    df = spark.createDataFrame(rows, "seq long, time long, x int, y int").withColumn("g", F.lit(1))
    assert {r.seq: r.seed for r in C.seed_clusters(df, ["g"], 3).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_seed_clusters_equal_a_fold(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(50), r.randrange(12), r.randrange(12), r.randrange(3)) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, time long, x int, y int, g int")
    expected = {}
    for g in range(3):
        left = sorted((x for x in rows if x[4] == g), key=lambda x: (x[1], x[0]))
        while left:
            seed, left_ = left[0], []
            for h in left:
                if (h[2] - seed[2]) ** 2 + (h[3] - seed[3]) ** 2 < 9:
                    expected[h[0]] = seed[0]
                else:
                    left_.append(h)
            left = left_
    assert {x.seq: x.seed for x in C.seed_clusters(df, ["g"], 3).collect()} == expected


def test_center_match_closes_on_a_repeated_plane(spark):
    rows = [("m", 0, 10, 10.0), ("m", 1, 12, 12.0), ("m", 0, 13, 13.0), ("m", 0, 14, 14.0), ("m", 1, 100, 100.0)]
    df = spark.createDataFrame(rows, "module string, plane int, time_start long, time_center double").withColumn("time_end", F.col("time_start"))
    found = M.center_match(df, ["module"], 20).collect()
    assert [(r.time_start, r.event) for r in sorted(found, key=lambda r: r.time_start)] == [(10, 0), (12, 0), (13, 1), (14, 2), (100, 3)]


def test_chrono_merge_horizon(spark):
    df = spark.createDataFrame([(0, 5), (1, 4), (2, 3), (2, 6), (1, 7), (0, 8)], "module int, time long")
    assert sorted(r.time for r in S.chrono_merge(df, "module", "time", 0).collect()) == [3, 4, 5]


def test_counter_gaps(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([5, 6, 6, 4, 9, 1, 2, 0])], "seq long, c long").withColumn("k", F.lit(1))
    row = S.counter_gaps(df, ["k"], "c", ["seq"]).first()
    assert (row.accepted, row.dropped, row.missed) == (6, 2, 2)


def test_as_of_carries_over_empty_slices(spark):
    left = spark.createDataFrame([(1, 5), (2, 95), (3, 1005)], "seq long, time long")
    right = spark.createDataFrame([(10, "a"), (90, "b")], "at long, name string")
    found = {r.seq: (r.at, r.name) for r in S.as_of(left, right, "time", "at", ["name"], 50).collect()}
    assert found == {1: (None, None), 2: (90, "b"), 3: (90, "b")}
