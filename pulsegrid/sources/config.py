"""Configuration and calibration files as small tables, with the checks that make a bad file fail on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    """A configuration file is not sound."""


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON file from any file system that Spark reads."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def required(config: dict, *keys: str):
    for key in keys:
        if key not in config:
            raise ConfigError(f"missing {key}")
    return tuple(config[k] for k in keys)


def unique(rows: list[dict], *keys: str) -> None:
    seen = set()
    for r in rows:
        at = tuple(r.get(k) for k in keys)
        if at in seen:
            raise ConfigError(f"duplicate {dict(zip(keys, at))}")
        seen.add(at)


def hybrids(spark: SparkSession, config: dict, detector: str, offsets=lambda cassette: (0, cassette * 32)) -> DataFrame:
    """Strip-detector hybrids: ring, fen, hybrid, hybrid_id, number, x_offset, y_offset, threshold0, threshold1."""
    name, rows = required(config, "Detector", "Config")
    if name != detector:
        raise ConfigError(f"expected {detector}, found {name}")
    unique(rows, "Ring", "FEN", "Hybrid")
    out = []
    for number, r in enumerate(rows):
        ring, fen, hybrid, hybrid_id = required(r, "Ring", "FEN", "Hybrid", "HybridId")
        if len(hybrid_id) != 32:
            raise ConfigError(f"hybrid id {hybrid_id!r} must have 32 characters")
        x, y = offsets(r.get("CassetteNumber", number + 1) - 1)
        low, high = r.get("Thresholds", [0, 0])[:2]
        out.append((ring, fen, hybrid, hybrid_id, number, x, y, low, high))
    return spark.createDataFrame(out, "ring int, fen int, hybrid int, hybrid_id string, number int, x_offset int, y_offset int, threshold0 int, threshold1 int")


def monitor_topology(spark: SparkSession, config: dict) -> DataFrame:
    """Beam-monitor topology by (fen, channel), with geometry and histogram settings."""
    _, rows = required(config, "Detector", "Topology")
    unique(rows, "FEN", "Channel")
    unique(rows, "Source")
    out = []
    for r in rows:
        fen, channel, kind, source = required(r, "FEN", "Channel", "Type", "Source")
        if not 0 <= fen <= config.get("MaxFENId", 23):
            raise ConfigError(f"FEN {fen} is out of range")
        out.append((fen, channel, source, kind.upper(), r.get("Schema", "EV44").upper(), r.get("PixelOffset", 0), r.get("Width", 0), r.get("Height", 0), r.get("MaxTofBin", 0), r.get("BinCount", 0), r.get("AggregatedFrames", 1)))
    return spark.createDataFrame(out, "fen int, channel int, source string, type string, schema string, pixel_offset int, width int, height int, max_tof_bin int, bin_count int, aggregated_frames int")


def tube_calibration(spark: SparkSession, config: dict, instrument: str) -> DataFrame:
    """(grp, unit, lo, hi, a, b, c, d): closed intervals in 0..1 that do not overlap, and four coefficients each."""
    (cal,) = required(config, "Calibration")
    name, groups, size, parameters = required(cal, "instrument", "groups", "groupsize", "Parameters")
    if name != instrument or len(parameters) != groups:
        raise ConfigError("instrument or number of groups is wrong")
    out = []
    for i, p in enumerate(parameters):
        index, intervals, polynomials = required(p, "groupindex", "intervals", "polynomials")
        if index != i or len(intervals) != size or len(polynomials) != size:
            raise ConfigError(f"group {i}: index or sizes are wrong")
        ends = sorted((min(x), max(x)) for x in intervals)
        if any(not 0 <= lo <= hi <= 1 for lo, hi in ends) or any(b[0] - a[1] < 1e-5 for a, b in zip(ends, ends[1:])):
            raise ConfigError(f"group {i}: intervals leave 0..1 or overlap")
        for unit, ((lo, hi), coefficients) in enumerate(zip(map(sorted, intervals), polynomials)):
            if len(coefficients) != 4:
                raise ConfigError(f"group {i}, unit {unit}: four coefficients are needed")
            out.append((i, unit, float(lo), float(hi), *map(float, coefficients)))
    return spark.createDataFrame(out, "grp int, unit int, lo double, hi double, a double, b double, c double, d double")


def channel_calibration(spark: SparkSession, config: dict, detector: str) -> DataFrame:
    """(hybrid_id, asic, channel, tdc_offset, tdc_slope, adc_offset, adc_slope), 64 values each."""
    name, version, rows = required(config, "Detector", "Version", "Calibrations")
    if name != detector or version != 1:
        raise ConfigError("detector or version is wrong")
    out = []
    for r in rows:
        (h,) = required(r, "VMMHybridCalibration")
        (hybrid_id,) = required(h, "HybridId")
        if len(hybrid_id) != 32:
            raise ConfigError("a hybrid id must have 32 characters")
        for asic in (0, 1):
            (values,) = required(h, f"vmm{asic}")
            columns = required(values, "tdc_offset", "tdc_slope", "adc_offset", "adc_slope")
            if any(len(v) != 64 for v in columns):
                raise ConfigError("64 values are needed for each channel setting")
            out += [(hybrid_id, asic, ch, *map(float, four)) for ch, four in enumerate(zip(*columns))]
    return spark.createDataFrame(out, "hybrid_id string, asic int, channel int, tdc_offset double, tdc_slope double, adc_offset double, adc_slope double")
