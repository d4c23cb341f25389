"""Packets of whole instruments, built by hand, lead to the events that their rules give."""

import struct

import pytest

from pulsegrid.plans import core
from pulsegrid.streaming.instruments import cdt_event_rows, instrument_events, panel_event_rows, strip_event_rows
from pulsegrid.streaming.pipeline import Settings
from tests.test_decode import header, packets

HYBRIDS = "ring int, fen int, hybrid int, number int, x_offset int, y_offset int, threshold0 int, threshold1 int"


def vmm(v, channel, low=88, adc=100, fiber=0, fen=0):
    return struct.pack("<BBHIIHHBBBB", fiber, fen, 20, 1000, low, 0, adc, 0, 0, v, channel)


def payload(spark, kind, *data):
    return packets(spark, [header(kind, len(d)) + d for d in data])


def test_strip_events(spark):
    """An event of two strips and one wire; a strip alone; a wire gap; strips and wire further apart than the gap."""
    two = vmm(1, 5) + vmm(1, 6, adc=300) + vmm(0, 20, low=90)
    apart = vmm(1, 5) + vmm(0, 20, low=88 + 60)
    gap = vmm(1, 5) + vmm(0, 20) + vmm(0, 23)
    source = payload(spark, 0x48, two, vmm(1, 5), gap, apart)
    hybrids = spark.createDataFrame([(0, 0, 0, 7, 0, 32, 10, 10)], HYBRIDS)
    rows = strip_event_rows(source, Settings("freia"), hybrids).orderBy("packet_id", "time_start").collect()
    assert [(r.packet_id, r.reject_reason) for r in rows] == [(0, None), (1, "strip_only"), (2, "wire_gap"), (3, "strip_only"), (3, "wire_only")]
    assert [(r.tof, r.pixel_id) for r in rows[:1]] == [(int(88 * 1e9 / 88_052_500), 57 + (32 + 27) * 64 + 1)]
    open_ = Settings("freia", options={"max_gap_wire": None})
    assert [r.packet_id for r in instrument_events(source, open_, {"hybrids": hybrids}).orderBy("packet_id").collect()] == [0, 2]
    with pytest.raises(ValueError):
        instrument_events(source, Settings("freia"))


def test_panel_events(spark):
    """The latest hit places a plane; a plane that spans more than ten coordinates is refused."""
    hybrids = spark.createDataFrame([(0, 0, 0, 2, 0, 0, False, 50), (0, 0, 1, 2, 1, 128, True, 50)], "ring int, fen int, hybrid int, panel int, plane int, offset int, reversed boolean, least_adc int")
    good = vmm(0, 10) + vmm(0, 11, low=90) + vmm(2, 20, low=89) + vmm(0, 40, adc=49)
    wide = vmm(0, 10) + vmm(0, 21) + vmm(2, 20)
    rows = panel_event_rows(payload(spark, 0x44, good, wide), Settings("nmx"), hybrids).orderBy("packet_id").collect()
    assert [(r.reject_reason, r.pixel_id) for r in rows] == [(None, 11 + (128 + 64 + 43) * 1280 + 1), ("span_max_x", rows[1].pixel_id)]
    assert rows[0].tof == int(90 * 1e9 / 88_052_500)


def test_cdt_events(spark):
    cdt = lambda fiber, fen, unit, cathode, anode: struct.pack("<BBHIIBBBB", fiber, fen, 16, 1000, 88, 0, unit, cathode, anode)
    modules = spark.createDataFrame([(0, 0, "FwEndCap", 1, 0), (1, 0, "DreamMantle", 4, 5), (2, 0, "PADetector", 0, 0)], "ring int, fen int, kind string, first int, second int")
    source = payload(spark, 0x60, cdt(0, 0, 6, 17, 18) + cdt(2, 0, 0, 3, 33) + cdt(4, 0, 0, 0, 0) + cdt(6, 0, 0, 0, 0) + cdt(0, 0, 7, 0, 0))
    rows = cdt_event_rows(source, Settings("dream"), modules).orderBy("pos").collect()
    assert [r.reject_reason for r in rows] == [None, None, "pixel", "mapping", "pixel"]
    assert [r.pixel_id for r in rows[:2]] == [(56 + 2 * 2 + 1) + (1 * 16 + 2) * 280 + 1, 229376 + 3 + (60 + 48 + 10 + 1) * 256 + 1]
    assert instrument_events(source, Settings("dream"), {"modules": modules}).count() == 2


def test_calibration_mode_passes_packets(spark):
    source = payload(spark, 0x48, vmm(1, 5))
    assert instrument_events(source, Settings("freia", raw=True)).collect() == source.collect()


@pytest.mark.parametrize("detector, number, module, pixel", [
    ("magic", 0x64, "PADetector", 245760 + (2 * 32 + 2 * (1 + 4 * 1) + 0) + ((70 % 32) * 16 + 1) * 256 + 1),
    ("magic", 0x64, "FRDetector", 70 + (60 * 1 + 12 * 2 + 2 * 3 + 1) * 128 + 1),
    ("heimdal", 0x68, "HeimdalMantle", 12 * 2 + 2 * 3 + 1 + (6 + 1 * 64) * 144 + 1),
])
def test_other_cdt_instruments(spark, detector, number, module, pixel):
    """Anode 33 is counter 1, wire 1 of a mantle, and cassette 1, counter 0, wire 1 of the other kind; cathode 70."""
    record = struct.pack("<BBHIIBBBB", 0, 0, 16, 1000, 88, 0, 0, 70, 33)
    modules = spark.createDataFrame([(0, 0, module, 2, 3)], "ring int, fen int, kind string, first int, second int")
    found = instrument_events(payload(spark, number, record), Settings(detector), {"modules": modules}).collect()
    assert [r.pixel_id for r in found] == [pixel]


def test_dream_code_is_compiled(spark, sf_dir):
    """Java compiles no method of 8000 bytes or more, and then runs it many times slower."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = core.queries()["instrument_dream"](spark, sf_dir)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    codes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan).iterator()
    sizes = []
    while codes.hasNext():
        sizes.append(codes.next()._3().maxMethodCodeSize())
    assert sizes and max(sizes) < 8000
