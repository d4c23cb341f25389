"""Expected results of the detector rules, stated by hand."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import pixels as P
from pulsegrid.operators import match as M
from pulsegrid.operators import stream_order as S


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("clusters, events", [
    ([(0, 100)], [0]),
    ([(0, 100), (0, 120)], [0, 1]),
    ([(0, 100), (0, 1000)], [0, 1]),
    ([(1, 100), (1, 120)], [0, 1]),
    ([(0, 100), (1, 125)], [0, 0]),
    ([(0, 100), (1, 1000)], [0, 1]),
    ([(0, 100), (1, 150), (0, 160)], [0, 0, 1]),
    ([(0, 100), (0, 150), (1, 160)], [0, 1, 1]),
    ([(0, 100), (0, 140), (1, 150), (1, 200)], [0, 1, 1, 2]),
    ([(1, 100), (1, 140), (0, 150), (0, 200)], [0, 1, 1, 2]),
    ([(0, 100), (1, 140), (0, 150), (1, 200)], [0, 0, 1, 1]),
])
def test_center_match_of_single_hits(spark, clusters, events):
    df = spark.createDataFrame([(1, p, t, t, float(t)) for p, t in clusters], "k int, plane int, time_start long, time_end long, time_center double")
    found = sorted((r.time_start, r.event) for r in M.center_match(df, ["k"], 100).collect())
    assert [e for _, e in found] == events


def test_center_match_measures_between_bounds(spark):
    """Centres 200 apart, but only 20 between the end of one and the start of the other."""
    df = spark.createDataFrame([(1, 0, 0, 180, 90.0), (1, 1, 200, 380, 290.0)], "k int, plane int, time_start long, time_end long, time_center double")
    assert {r.event for r in M.center_match(df, ["k"], 20).collect()} == {0}
    assert {r.event for r in M.center_match(df, ["k"], 19).collect()} == {0, 1}


def plane_hits(plane, *parts):
    """Hits on the coordinates from..to of each part, with its weight."""
    return [(plane, c, w) for w, low, high in parts for c in range(low, high + 1)]


@pytest.mark.parametrize("hits, pairing", [
    (plane_hits(0, (10, 50, 55)) + plane_hits(1, (10, 100, 109)), "discarded"),  # one wide plane of other weight
    (plane_hits(0, (10, 50, 55)) + plane_hits(1, (10, 100, 105)), "whole"),
    (plane_hits(0, (10, 50, 61)) + plane_hits(1, (10, 100, 111)), "whole"),  # wide and unbroken, weights agree
    (plane_hits(0, (10, 50, 55), (100, 200, 205)) + plane_hits(1, (10, 100, 105), (100, 10, 15)), "crossed"),
    (plane_hits(0, (10, 50, 55), (100, 200, 205)) + plane_hits(1, (10, 10, 15), (100, 100, 105)), "straight"),
    (plane_hits(0, (10, 50, 55), (10, 200, 205)) + plane_hits(1, (10, 100, 105)), "discarded"),
    (plane_hits(0, (10, 100, 105)) + plane_hits(1, (10, 50, 55), (10, 200, 205)), "discarded"),
    (plane_hits(0, (10, 50, 55), (10, 200, 205)) + plane_hits(1, (10, 50, 55), (10, 200, 205)), "discarded"),  # all links hold
    (plane_hits(0, (10, 0, 5), (100, 50, 55), (10, 99, 99)) + plane_hits(1, (10, 10, 15), (100, 100, 105)), "discarded"),  # third part
    (plane_hits(0, (10, 50, 90)), "discarded"),  # one wide plane alone
    (plane_hits(0, (10, 50, 52)), "whole"),
])
def test_split(spark, hits, pairing):
    df = spark.createDataFrame([(1, i, *h) for i, h in enumerate(hits)], "event int, seq long, plane int, coordinate int, weight int")
    assert M.split_events(df, ["event"], low=0.8, high=1.2).first().pairing == pairing


@pytest.mark.parametrize("bins, extra, expected", [
    (1, [], (2.0, 1, 1, 1)), (2, [], (2.0, 1, 2, 1)), (2, [(31, 2)], (16.5, 30, 31, 2)), (5, [(31, 2)], (16.5, 30, 32, 2)),
])
def test_utpc_uncertainty(spark, bins, extra, expected):
    df = spark.createDataFrame([(1, c, t, 1) for c, t in [(0, 0), (1, 1), (2, 2), *extra]], "k int, coordinate int, time long, weight int")
    r = M.utpc_uncertainty(df, ["k"], bins, weighted=True).first()
    assert (r.center, r.uncert_lower, r.uncert_upper, r.hits_used) == expected


@pytest.mark.parametrize("counters, expected", [([0, 0, 1, 1, 2], (3, 2, 0)), ([1, 0, 0, 3], (3, 1, 2)), ([7, 1, 1, 7], (3, 1, 5))])
def test_equal_counters_are_dropped(spark, counters, expected):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(counters)], "k int, seq long, c long")
    r = S.counter_gaps(df, ["k"], "c", ["seq"]).first()
    assert (r.accepted, r.dropped, r.missed) == expected


def let_wire(ring, hybrid, asic, channel, x_offset=0, rotated=False):
    second = F.when(F.lit(ring) % 2 == 0, 1).otherwise(0)
    return P.trex_wire(second, F.lit(hybrid), F.lit(asic), P.swap_odd_even(F.lit(channel)), F.lit(rotated), F.lit(x_offset), wires=P.LET_WIRES)


@pytest.mark.parametrize("place, wire", [((1, 1, 0, 33), 0), ((0, 1, 0, 33), 96), ((1, 1, 1, 1), 32), ((0, 1, 0, 0), None), ((0, 0, 0, 10), None), ((1, 0, 0, 33), None), ((1, 2, 0, 33), None)])
def test_let_wires(spark, place, wire):
    assert value(spark, let_wire(*place)) == wire


@pytest.mark.parametrize("place, grid", [((1, 0, 58), 0), ((2, 1, 5), 139), ((1, 0, 57), None), ((1, 1, 0), 6), ((2, 0, 0), 70), ((0, 0, 58), None)])
def test_full_grids(spark, place, grid):
    assert value(spark, P.trex_grid(*(F.lit(v) for v in place), F.lit(False), F.lit(False), F.lit(0))) == grid


def test_short_grids_of_let_are_on_hybrid_0(spark):
    grid = lambda h, **k: value(spark, P.trex_grid(F.lit(h), F.lit(0), F.lit(40), F.lit(True), F.lit(True), F.lit(50), **k))
    assert (grid(0, short_hybrid=P.LET_SHORT_GRIDS), grid(1, short_hybrid=P.LET_SHORT_GRIDS), grid(1), grid(0)) == (10, None, 10, None)


@pytest.mark.parametrize("unit, cassette, further", [(0, 0, 0), (1, 0, 12), (2, 0, 24), (11, 5, 142)])
def test_heimdal(spark, unit, cassette, further):
    assert value(spark, P.heimdal(F.lit(unit), F.lit(cassette), F.lit(70), F.lit(70))) == 56161 + further


def test_mantle_has_32_wires_a_counter(spark):
    assert value(spark, P.mantle(F.lit(0), F.lit(0), F.lit(31), F.lit(0))) == 60 * 31 * 256 + 1
    assert value(spark, P.mantle(F.lit(0), F.lit(0), F.lit(32), F.lit(5))) == 256 + 5 + 1
    assert value(spark, P.mantle(F.lit(0), F.lit(0), F.lit(0), F.lit(130), strips=128)) == 3


def test_neighbours_and_ranks_cross_slices(spark):
    rows = [(k, t, i) for k in ("a", None) for i, t in enumerate([1, 2, 2, 95, 96, 1005])]
    df = spark.createDataFrame(rows, "k string, t long, i int")
    for ahead, expected in ((False, [None, 0, 1, 2, 3, 4]), (True, [1, 2, 3, 4, 5, None])):
        found = S.neighbour(df, ["k"], ["t", "i"], ["i"], 50, ahead).orderBy("k", "i").collect()
        assert [r.beside and r.beside.i for r in found] == expected * 2
    assert {(r.k, r.i, r.n) for r in S.numbered(df, "t", 50, "n", ["k"], ["i"]).collect()} == {(k, i, i + 1) for k, _, i in rows}


@pytest.mark.parametrize("kind, unit, first, second, pixel", [
    ("sans", 0, 0, 40, 15 * 112 + 32 + 1), ("sans", 1, 40, 0, 15 * 112 + 32 + 1), ("sans", 2, 0, 0, None), ("sans", 0, 36, 0, None), ("sans", 0, 35, 0, 96 * 112 + 64 + 15 + 1),
    ("hr", 0, 32, 0, 96 * 112 + 64 + 15 + 1), ("hr", 0, 33, 0, None),
])
def test_cuboids(spark, kind, unit, first, second, pixel):
    """Anode and cathode 0 are the local cell (0, 15); two quarter turns take it to (15, 0)."""
    assert value(spark, P.cuboid_at(kind, *(F.lit(v) for v in (unit, first, second, 0, 0)))) == pixel
