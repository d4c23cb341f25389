"""Packets built with struct are decoded with the error rules of their format."""

import struct

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import pixels as P
from pulsegrid.functions import timebase as T
from pulsegrid.functions import validate as V
from pulsegrid.sources import decode, encode
from pulsegrid.streaming.pipeline import Settings, caen_events, caen_rows, vmm_hits


def header(kind, n, version=0, cookie=0x535345, pad=0, queue=0, pulse=(1000, 0), prev=(1000, 0), seq=0, extra=0):
    size = 30 if version == 0 else 32
    body = struct.pack("<BB", pad, version) + cookie.to_bytes(3, "little") + struct.pack("<BHBBIIIII", kind, size + n + extra, queue, 0, *pulse, *prev, seq)
    return body + b"\0\0" * (version == 1)


def caen(fiber=0, fen=0, length=24, high=1001, low=0, grp=0, amps=(0, 0, 0, 0)):
    return struct.pack("<BBHIIBBHhhhh", fiber, fen, length, high, low, 0, grp, 0, *amps)


def packets(spark, payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "packet_id long, payload binary")


def test_header_rules(spark):
    cases = [
        (header(0x34, 0), "ok"), (header(0x34, 0, version=1), "ok"), (b"", "empty"), (b"1234", "size"), (header(0x34, 0, pad=1), "pad"), (header(0x34, 0, version=2), "version"),
        (header(0x34, 0, cookie=0x535346), "cookie"), (header(0x34, 0)[:29], "header"), (header(0x34, 0, extra=1), "length"), (header(0x35, 0), "type"), (header(0x34, 0, queue=12), "queue"),
        (header(0x34, 0, pulse=(1, T.TICKS)), "pulse_ticks"), (header(0x34, 0, prev=(1, T.TICKS)), "prev_ticks"), (header(0x34, 0, pulse=(1002, 0)), "pulse_gap"), (None, "empty"),
    ]
    found = decode.with_header(packets(spark, [p for p, _ in cases]), 0x34).orderBy("packet_id").collect()
    assert [r.reject_reason or "ok" for r in found] == [c for _, c in cases]


def test_strict_format_gives_up_and_keeps_the_prefix(spark):
    data = caen(amps=(1, -2, 3, -4)) + caen(fen=24) + caen() + b"xx"
    rows = decode.readouts(spark.createDataFrame([(1, data), (2, b"")], "packet_id long, data binary"), "caen", ["packet_id"]).orderBy("pos").collect()
    assert [r.reject_reason for r in rows] == [None, "fen", "after_bad", "after_bad"]
    short = decode.readouts(spark.createDataFrame([(1, caen() + b"xx")], "packet_id long, data binary"), "caen", ["packet_id"]).orderBy("pos").collect()
    assert [r.reject_reason for r in short] == [None, "truncated"]
    assert (rows[0].amp_a, rows[0].amp_b, rows[0].amp_c, rows[0].amp_d, rows[0].time_high) == (1, -2, 3, -4, 1001)


def test_vmm3_skips_bad_rows_and_whole_payloads(spark):
    def vmm(otadc=1, channel=0, low=0):
        return struct.pack("<BBHIIHHBBBB", 0, 0, 20, 1, low, 0, otadc, 0, 0, 0, channel)

    data = [vmm() + vmm(otadc=1024) + vmm(channel=64) + vmm(low=T.TICKS) + vmm(otadc=0x8001), vmm() + b"x"]
    rows = decode.readouts(spark.createDataFrame(list(enumerate(data)), "packet_id long, data binary"), "vmm3", ["packet_id"]).orderBy("packet_id", "pos").collect()
    assert [r.reject_reason for r in rows] == [None, "adc", "channel", "time_low", None, "payload_size"]


def test_camera_words(spark):
    pixel = 11 << 60 | 3 << 53 | 2 << 47 | 5 << 44 | 100 << 30 | 7 << 20 | 1 << 16 | 9
    tdc = 6 << 60 | 15 << 56 | 17 << 44 | 12345 << 9 | 3 << 5
    evr = struct.pack("<BBHIIIII", 1, 0, 0, 42, 10, 20, 9, 8)
    data = struct.pack("<QQQ", pixel, tdc, 1 << 60) + struct.pack("<Q", pixel)
    rows = {(r.packet_id, r.pos): r for r in decode.camera_words(packets(spark, [data, evr]), ["packet_id"]).collect()}
    assert [rows[0, i].kind for i in range(4)] == ["pixel", "tdc", "undefined", "pixel"]
    p, t, e = rows[0, 0], rows[0, 1], rows[1, 0]
    assert (p.dcol, p.spix, p.pix, p.toa, p.tot, p.ftoa, p.spidr) == (6, 8, 5, 100, 7, 1, 9)
    assert (t.trigger, t.timestamp, t.stamp) == (17, 12345, 3)
    assert (e.kind, e.counter, e.pulse_s, e.prev_ns) == ("evr", 42, 10, 8)


def test_encode_is_the_inverse(spark):
    rec = encode.record("caen", {"fiber": F.lit(3), "amp_b": F.lit(-5), "time_low": F.lit(70000)})
    assert bytes(spark.range(1).select(rec).first()[0]) == struct.pack("<BBHIIBBHhhhh", 3, 0, 24, 0, 70000, 0, 0, 0, 0, -5, 0, 0)


def test_tof_limit_is_inclusive(spark):
    longest = 20 * 71_428_571
    rows = spark.createDataFrame([(37736785,), (37736786,)], "low long").select(T.tof(T.clock_to_ns(F.lit(1001), F.col("low")), F.lit(1000 * 10**9), F.lit(1000 * 10**9), longest).alias("t")).collect()
    assert [(r.t.tof, r.t.reject) for r in rows] == [(1428571420, None), (None, "tof_high")]


def test_previous_pulse(spark):
    rows = spark.createDataFrame([(150,), (50,), (5,)], "t long").select(T.tof(F.col("t"), F.lit(100), F.lit(10), 60).alias("t")).collect()
    assert [(r.t.tof, r.t.reject) for r in rows] == [(50, None), (40, None), (None, "prev_tof_negative")]


def test_time_carries(spark):
    row = spark.range(1).select(T.ns_to_clock(F.lit(1_999_999_999).cast("long")).alias("a"), T.add_ns(F.lit(1), F.lit(T.TICKS - 1), F.lit(1_000_000_100).cast("long")).alias("b"), T.hz_to_ns(F.lit(14)).alias("c")).first()
    assert (tuple(row.a), tuple(row.b), row.c) == ((2, 0), (3, 7), 71428571)


def test_logical_grid(spark):
    cells = spark.range(5 * 7 * 11 * 3).select(*(((F.col("id") / d).cast("long") % n).alias(c) for c, d, n in (("x", 1, 5), ("y", 5, 7), ("z", 35, 11), ("p", 385, 3))))
    ids = [r[0] for r in cells.select(P.pixel_panels3d(*map(F.col, "xyzp"), 5, 7, 11, 3)).collect()]
    assert sorted(ids) == list(range(1, 1156))
    assert spark.range(1).select(P.pixel2d(F.lit(-1), F.lit(0), 5, 7), P.pixel2d(F.lit(5), F.lit(0), 5, 7)).first() == (None, None)
    assert [r[0] for r in spark.createDataFrame([(1,), (3,), (64,), (65,)], "n long").select(P.next_power_of_two(F.col("n"))).collect()] == [1, 4, 64, 128]


def test_tube_pipeline(spark):
    good = header(0x3C, 48) + caen(grp=1, low=500, amps=(10, 30, 0, 0)) + caen(fiber=23, fen=12, amps=(1, 1, 0, 0))
    rows, every = caen_rows(packets(spark, [good, header(0x34, 0)]), Settings("cspec"))
    assert [r.reject_reason for r in every.orderBy("pos").collect()] == [None, "fen"]
    event = caen_events(packets(spark, [good]), Settings("cspec")).collect()
    assert [(e.reference_time, e.tof, e.pixel_id) for e in event] == [(1000 * 10**9, 10**9 + 5678, 3 + (74 * 10 // 40) * 900 + 1)]


CALIBRATION = "grp int, unit int, lo double, hi double, a double, b double, c double, d double"


def test_bifrost_pipeline(spark):
    """Group 19 (ring 1, group 4): a position in a unit, one between units, one of a group without calibration, a reject."""
    tables = {"calibration": spark.createDataFrame([(19, i, lo, hi, 0.0, 0.0, 0.0, 0.0) for i, (lo, hi) in enumerate([(0.0, 0.3), (0.35, 0.6), (0.7, 1.0)])], CALIBRATION)}
    data = caen(fiber=2, grp=4, amps=(10, 10, 0, 0)) + caen(fiber=2, grp=4, amps=(32, 68, 0, 0)) + caen(fiber=2, grp=5, amps=(1, 1, 0, 0)) + caen(fiber=2, grp=15, amps=(1, 1, 0, 0))
    payload = packets(spark, [header(0x34, len(data)) + data])
    assert [e.pixel_id for e in caen_events(payload, Settings("bifrost"), tables).collect()] == [300 + 100 + 59 + 4 * 900 + 1]
    assert [r.reject_reason for r in caen_rows(payload, Settings("bifrost"), tables)[1].orderBy("pos").collect()] == [None, None, None, "group"]


def test_tbl3he_pipeline(spark):
    """The correction is of the position within the unit: 0.4 of 0..0.8 is 0.5, less 0.1."""
    tables = {"banks": spark.createDataFrame([(2, 1, 1)], "ring int, fen int, bank int"), "calibration": spark.createDataFrame([(6, 0, 0.0, 0.8, 0.1, 0.0, 0.0, 0.0)], CALIBRATION)}
    data = caen(fiber=4, fen=1, grp=2, amps=(40, 60, 0, 0)) + caen(fiber=4, fen=2, grp=2, amps=(40, 60, 0, 0)) + caen(fiber=4, fen=1, grp=2, amps=(9, 60, 0, 0)) + caen(fiber=4, fen=1, grp=2, amps=(90, 10, 0, 0))
    payload = packets(spark, [header(0x32, len(data)) + data])
    assert [e.pixel_id for e in caen_events(payload, Settings("tbl3he"), tables).collect()] == [39 + 6 * 100 + 1]
    assert [r.reject_reason for r in caen_rows(payload, Settings("tbl3he"), tables)[1].orderBy("pos").collect()] == [None, "topology", "amplitude_low", None]
    with pytest.raises(ValueError):
        caen_events(payload, Settings("tbl3he"))


def test_loki_pipeline(spark):
    tables = {"banks": spark.createDataFrame([(1, 0, 4, 2, 0, 8)], "ring int, bank int, bank_fens int, fen_offset int, bank_y int, groups_n int"),
              "calibration": spark.createDataFrame([(15, 0, 0.0, 0.4, 0.0, 0.0, 0.0, 0.0), (15, 1, 0.5, 1.0, 0.25, 0.0, 0.0, 0.0)], CALIBRATION)}
    data = caen(fiber=2, fen=1, grp=5, amps=(10, 20, 0, 10)) + caen(fiber=2, fen=1, grp=5) + caen(fiber=2, fen=4, grp=5, amps=(1, 1, 1, 1)) + caen(fiber=4, fen=1, grp=5, amps=(1, 1, 1, 1))
    payload = packets(spark, [header(0x30, len(data)) + data])
    settings = Settings("loki", options={"resolution": 512, "total_groups": 32})
    assert [e.pixel_id for e in caen_events(payload, settings, tables).collect()] == [round(0.5 * 511 + 1e-9) + (56 + 42 + 7 + 1) * 512 + 1]
    assert [r.reject_reason for r in caen_rows(payload, settings, tables)[1].orderBy("pos").collect()] == [None, None, "fen", "bank"]


def test_strip_pipeline(spark):
    vmm = lambda v, ch, adc: struct.pack("<BBHIIHHBBBB", 0, 0, 20, 1001, 88, 0, adc, 0, 0, v, ch)
    data = vmm(0, 20, 100) + vmm(1, 5, 100) + vmm(0, 10, 100) + vmm(0, 20, 5) + vmm(4, 20, 100)
    hybrids = spark.createDataFrame([(0, 0, 0, 7, 0, 32, 10, 10)], "ring int, fen int, hybrid int, number int, x_offset int, y_offset int, threshold0 int, threshold1 int")
    found = vmm_hits(packets(spark, [header(0x48, 100) + data]), Settings("freia"), hybrids).orderBy("seq").collect()
    assert [(r.module, r.plane, r.coordinate, r.weight) for r in found] == [(7, 1, 32 + 27, 100), (7, 0, 58, 100)]


def test_time_source_flags(spark):
    rows = spark.createDataFrame([(0,), (2,), (3,), (8,), (32 + 128 + 1,)], "b int").select(decode.time_source_flags(F.col("b"))).collect()
    assert [r[0] for r in rows] == [[], ["sync_source"], [], ["timing_status"], ["even_fibre_sync", "odd_fibre_sync"]]


def test_counters(spark):
    df = V.with_reject(spark.range(10).select(F.col("id").alias("v")), [("low", F.col("v") < 3), ("odd", F.col("v") % 2 == 1)])
    assert {r.reason: r.n for r in V.counters(df).collect()} == {"low": 3, "odd": 4, "ok": 3}
