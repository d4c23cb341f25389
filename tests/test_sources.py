"""Configuration checks, file sources and the pipeline handle."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import config, files
from pulsegrid.streaming.pipeline import PipelineHandle, Settings, type_number, verify_metrics

ID = "0123456789abcdef0123456789abcdef"


def test_hybrids(spark, tmp_path):
    good = {"Detector": "freia", "Config": [{"Ring": 0, "FEN": 1, "Hybrid": 2, "HybridId": ID, "CassetteNumber": 3, "Thresholds": [5, 6]}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(good, indent=1))
    row = config.hybrids(spark, config.read_json(spark, str(path)), "freia").first()
    assert (row.number, row.y_offset, row.threshold1) == (0, 64, 6)
    for bad in ({**good, "Detector": "nmx"}, {"Detector": "freia"}, {**good, "Config": good["Config"] * 2}, {**good, "Config": [{**good["Config"][0], "HybridId": "short"}]}):
        with pytest.raises(config.ConfigError):
            config.hybrids(spark, bad, "freia")


def test_tube_calibration(spark):
    good = {"Calibration": {"instrument": "t", "groups": 1, "groupsize": 2, "Parameters": [{"groupindex": 0, "intervals": [[0.0, 0.4], [0.5, 1.0]], "polynomials": [[0, 0, 0, 0], [0.1, 0, 0, 0]]}]}}
    assert config.tube_calibration(spark, good, "t").count() == 2
    touching = json.loads(json.dumps(good))
    touching["Calibration"]["Parameters"][0]["intervals"] = [[0.0, 0.5], [0.5, 1.0]]
    short = json.loads(json.dumps(good))
    short["Calibration"]["Parameters"][0]["polynomials"][0] = [0]
    for bad in (touching, short):
        with pytest.raises(config.ConfigError):
            config.tube_calibration(spark, bad, "t")
    with pytest.raises(config.ConfigError):
        config.tube_calibration(spark, good, "other")


def test_channel_calibration(spark):
    four = {k: [0.5] * 64 for k in ("tdc_offset", "tdc_slope", "adc_offset", "adc_slope")}
    good = {"Detector": "freia", "Version": 1, "Calibrations": [{"VMMHybridCalibration": {"HybridId": ID, "vmm0": four, "vmm1": four}}]}
    assert config.channel_calibration(spark, good, "freia").count() == 128
    with pytest.raises(config.ConfigError):
        config.channel_calibration(spark, {**good, "Version": 2}, "freia")


def test_monitor_topology(spark):
    row = {"FEN": 0, "Channel": 1, "Type": "event_2d", "Source": "a"}
    assert config.monitor_topology(spark, {"Detector": "cbm", "Topology": [row]}).first().type == "EVENT_2D"
    for bad in ([row, row], [{**row, "FEN": 99}], [{"FEN": 0}]):
        with pytest.raises(config.ConfigError):
            config.monitor_topology(spark, {"Detector": "cbm", "Topology": bad})


def capture():
    def frame(proto, payload):
        udp = struct.pack(">HHHH", 1, 2, 8 + len(payload), 0) + payload
        return bytes(12) + b"\x08\0" + struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(udp), 0, 0, 64, proto, 0, 0, 0) + udp

    out = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1)
    for data, cut in ((frame(17, b"hello"), 0), (frame(6, b"tcp"), 0), (frame(17, b"long"), 5)):
        out += struct.pack("<IIII", 3, 7, len(data) - cut, len(data)) + data[: len(data) - cut]
    return out


def test_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture())
    rows = files.read_captures(spark, str(tmp_path)).orderBy("number").collect()
    assert [(r.status, bytes(r.payload)) for r in rows] == [("ok", b"hello"), ("not_udp", b""), ("truncated", b"")]
    assert rows[0].ns == 3_000_007_000


def test_dat_and_synthetic(spark, tmp_path):
    (tmp_path / "a.dat").write_text("ring fen hi lo tube a b\n0 1 10 20 3 100 200\n\n1 1 10 21 3 1 2\n")
    assert [(r.ring, r.amp_b) for r in files.read_dat(spark, str(tmp_path / "a.dat")).orderBy("ring").collect()] == [(0, 200), (1, 2)]
    assert [r.value for r in files.linear(spark, 3, 1.0, 0.5).orderBy("seq").collect()] == [1.0, 1.5, 2.0]
    mean = files.sampled(spark, 20_000).agg(F.avg("value")).first()[0]
    assert 33 < mean < 36
    image = spark.createDataFrame([(5,), (9,), (7,)], "pixel_id long")
    assert sorted(tuple(r) for r in files.image_events(spark, image, 2, 2).collect()) == [(0, 0, 5), (0, 1, 7), (1, 0, 5), (1, 1, 7)]
    raw = files.raw_messages(spark.createDataFrame([(4, b"x"), (2, b"y")], "packet_id long, payload binary"), "s").orderBy("seq").collect()
    assert [(r.seq, bytes(r.payload)) for r in raw] == [(0, b"y"), (1, b"x")]


def test_handle(spark):
    handle = PipelineHandle(spark, Settings("cspec"), {"HELLO": lambda n: n + 1})
    handle.update(spark.createDataFrame([("fen", 3), ("ok", 9)], "reason string, n long"))
    assert (handle.run("STAT_GET 1"), handle.run("STAT_GET ok"), handle.run("STAT_GET_COUNT"), handle.run("HELLO 4")) == (3, 9, 2, 5)
    assert (handle.run("RUNTIMESTATS"), handle.run("RUNTIMESTATS")) == (3, 0)
    handle.run("CALIB_MODE_SET 1")
    assert handle.run("CALIB_MODE_GET") == 1
    with pytest.raises(KeyError):
        handle.run("NO_SUCH")
    assert verify_metrics({"a": 3, "b": 5}, ["a:3", "b:+4", "b:6", "c:0", "d:+1"]) == ["b:6", "d:+1"]
    assert type_number("FREIA") == 0x48
