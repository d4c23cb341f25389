"""Instrument pipelines: packets to pixel events or histograms, for batch and streaming DataFrames alike; and their handle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions import pixels as P
from pulsegrid.functions import validate as V
from pulsegrid.functions.timebase import clock_to_ns, quantised, tof
from pulsegrid.operators.lookup import corrected, interval_of, interval_table, lookup
from pulsegrid.sources import decode

VERSION = "0.1"
# Detector type numbers in packet headers.
TYPES = {
    "cbm": 0x10, "loki": 0x30, "tbl3he": 0x32, "bifrost": 0x34, "miracles": 0x38, "cspec": 0x3C, "trex": 0x40, "nmx": 0x44,
    "freia": 0x48, "tblmb": 0x49, "estia": 0x4C, "beer": 0x50, "dream": 0x60, "magic": 0x64, "heimdal": 0x68,
}


def type_number(name: str) -> int:
    """Detector type by name, whatever its case."""
    return TYPES[name.lower()]


@dataclass
class Settings:
    detector: str
    longest_tof_ns: int = 2**31 - 1
    samples: int = 2
    sample_period: int = 1000
    raw: bool = False  # calibration mode: packets pass as they are, processing is skipped
    flush: str = "1 second"
    options: dict = field(default_factory=dict)


#: The tables that a detector needs beside its packets.
TABLES = {"loki": ("banks", "calibration"), "bifrost": ("calibration",), "tbl3he": ("banks", "calibration")}


def caen_rows(packets: DataFrame, settings: Settings, tables: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted readouts with time of flight, all readouts with reject_reason) of a tube detector's packets.

    ``tables``: ``banks`` of tbl3he (ring, fen, bank) or loki (ring, bank, bank_fens, fen_offset, bank_y, groups_n), and
    ``calibration`` as sources.config.tube_calibration gives it, by global group. settings.options: least_amplitude
    (tbl3he), resolution and total_groups (loki).
    """
    missing = [t for t in TABLES.get(settings.detector, ()) if t not in (tables or {})]
    if missing:
        raise ValueError(f"{settings.detector} needs the tables {missing}")
    headed = decode.with_header(packets, type_number(settings.detector))
    good = headed.where("reject_reason IS NULL")
    rows = decode.readouts(good, "caen", ["packet_id", "pulse", "previous"])
    c = F.col
    g, a, b = c("grp"), c("amp_a"), c("amp_b")
    if settings.detector in ("loki", "tbl3he"):
        rows = lookup(rows.withColumns({"ring": V.ring(c("fiber")), "fen": c("fen").cast("int")}), tables["banks"], ["ring"] if settings.detector == "loki" else ["ring", "fen"])
    rules = {
        "bifrost": lambda: V.bifrost(c("fiber"), c("fen"), g, a, b), "miracles": lambda: V.miracles(c("fiber"), a, b),
        "cspec": lambda: V.cspec(c("fiber"), c("fen"), g), "loki": lambda: V.loki(c("fiber"), c("fen"), c("bank"), c("bank_fens")),
        "tbl3he": lambda: V.tbl3he(c("fiber"), g, c("bank"), a, b, least=settings.options.get("least_amplitude", 10)),
    }[settings.detector]()
    flight = tof(clock_to_ns(c("time_high"), c("time_low")), c("pulse"), c("previous"), settings.longest_tof_ns)
    rows = rows.withColumn("t", flight)
    rows = rows.withColumn("reject_reason", F.coalesce("reject_reason", V.first_reject(rules), c("t.reject"))).withColumn("tof", c("t.tof")).drop("t")
    return V.accepted(rows), rows


def calibrated(rows: DataFrame, settings: Settings, calibration: DataFrame) -> DataFrame:
    """Accepted readouts with ``pixel_id`` by the intervals and corrections of their global group; null where no unit fits."""
    c, ring, g = F.col, V.ring(F.col("fiber")), F.col("grp")
    a, b, both = c("amp_a"), c("amp_b"), c("amp_a") + c("amp_b")
    along = F.try_divide(a.cast("double"), both)
    chosen = along
    if settings.detector == "bifrost":
        group = ring * 15 + g
    elif settings.detector == "tbl3he":
        group = c("bank") * 4 + g
    else:
        group = P.loki_group(c("bank_y"), c("groups_n"), c("fen_offset"), c("fen"), g)
        total = both + c("amp_c") + c("amp_d")
        along, chosen = F.try_divide(both.cast("double"), total), F.try_divide((b + c("amp_d")).cast("double"), total)
    named = interval_table(calibration.withColumnRenamed("grp", "global_group"), "global_group")
    found = lookup(rows.withColumn("global_group", group.cast("int")), named, ["global_group"]).withColumn("u", interval_of(c("units"), chosen))
    relative = (along - c("u.lo")) / (c("u.hi") - c("u.lo"))
    if settings.detector == "bifrost":
        pixel = P.bifrost(ring, g, c("u.unit"), relative)
    elif settings.detector == "tbl3he":
        pixel = P.tbl3he(c("bank"), g, corrected(c("u"), relative))
    else:
        o = settings.options
        pixel = P.loki(c("bank_y"), c("groups_n"), c("fen_offset"), c("fen"), g, c("u.unit"), corrected(c("u"), along), o["resolution"], o["total_groups"])
    return found.withColumn("pixel_id", F.when(c("u").isNotNull() & along.between(0, 1), pixel)).drop("units", "u")


def caen_events(packets: DataFrame, settings: Settings, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """packet_id, reference time, tof and pixel id of a tube detector's events."""
    rows, _ = caen_rows(packets, settings, tables)
    c, ring = F.col, V.ring(F.col("fiber"))
    if settings.detector in TABLES:
        placed = calibrated(rows, settings, tables["calibration"])
    else:
        pixel = {"cspec": lambda: P.cspec(ring, c("grp"), c("amp_a"), c("amp_b")), "miracles": lambda: P.miracles(ring, c("grp"), c("amp_a"), c("amp_b"))}[settings.detector]()
        placed = rows.withColumn("pixel_id", pixel)
    return placed.where("pixel_id IS NOT NULL").select("packet_id", c("pulse").alias("reference_time"), "tof", "pixel_id")


def vmm_hits(packets: DataFrame, settings: Settings, hybrids: DataFrame) -> DataFrame:
    """Hits of a strip detector's packets: packet_id, module (hybrid number), plane, time in ns, coordinate, weight.

    ``hybrids``: ring, fen, hybrid, number, x_offset, y_offset, threshold0, threshold1; at most a few thousand rows.
    """
    good = decode.with_header(packets, type_number(settings.detector)).where("reject_reason IS NULL")
    rows = V.accepted(decode.readouts(good, "vmm3", ["packet_id", "pulse", "previous"]))
    c = F.col
    rows = rows.withColumns({"ring": V.ring(c("fiber")), "hybrid": P.vmm_hybrid(c("vmm")), "asic": P.vmm_asic(c("vmm"))})
    rows = lookup(rows.withColumn("fen", c("fen").cast("int")), hybrids, ["ring", "fen", "hybrid"])
    threshold = F.when(c("asic") == 0, c("threshold0")).otherwise(c("threshold1"))
    rows = V.accepted(V.with_reject(rows, [*V.vmm_family(c("ring"), c("fen"), c("number"), c("vmm"), c("channel")), *V.adc_threshold(c("otadc"), threshold)]))
    x_plane = c("asic") == 1
    coordinate = F.when(x_plane, P.strip(c("x_offset"), c("channel"))).otherwise(P.wire(c("y_offset"), c("channel")))
    time = quantised(clock_to_ns(c("time_high"), c("time_low")))
    return rows.select("packet_id", "pulse", "previous", c("number").alias("module"), F.when(x_plane, 0).otherwise(1).alias("plane"), c("pos").alias("seq"), time.alias("time"), coordinate.cast("int").alias("coordinate"), P.adc10(c("otadc")).alias("weight"))


class PipelineHandle:
    """Control of a running pipeline: version, counters by name or number, calibration mode, custom commands."""

    def __init__(self, spark: SparkSession, settings: Settings, commands: dict[str, Callable] | None = None):
        self.spark, self.settings = spark, settings
        self._counters: dict[str, int] = {}
        self._seen: dict[str, int] = {}
        self.query: StreamingQuery | None = None
        self.commands = {"VERSION_GET": lambda: VERSION, "DETECTOR_INFO_GET": lambda: settings.detector, "STAT_GET_COUNT": lambda: len(self._counters), "STAT_GET": self.counter, "CALIB_MODE_SET": self.set_raw, "CALIB_MODE_GET": lambda: settings.raw, "RUNTIMESTATS": self.runtime_mask, "EXIT": self.stop} | (commands or {})

    def update(self, counters: DataFrame) -> None:
        """Take over a counters table (reason, n)."""
        for r in counters.collect():  # one row a rule
            self._counters[r["reason"]] = self._counters.get(r["reason"], 0) + r["n"]

    def counter(self, which: str | int) -> int:
        """By name, or by 1-based number in order of name."""
        return self._counters[sorted(self._counters)[which - 1] if isinstance(which, int) else which]

    def set_raw(self, on: bool) -> None:
        self.settings.raw = on

    def runtime_mask(self) -> int:
        """Bit i is set if the i-th counter changed since the last look."""
        names = sorted(self._counters)
        mask = sum(1 << i for i, n in enumerate(names) if self._counters[n] != self._seen.get(n, 0))
        self._seen = dict(self._counters)
        return mask

    def run(self, line: str):
        """A command line of words; unknown commands raise KeyError."""
        name, *words = line.split()
        return self.commands[name](*(int(w) if w.lstrip("-").isdigit() else w for w in words))

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()


def verify_metrics(counters: dict[str, int], expected: list[str]) -> list[str]:
    """Checks ``name:value`` (exact) and ``name:+value`` (at least); returns those that fail."""
    failed = []
    for item in expected:
        name, _, value = item.rpartition(":")
        found = counters.get(name, 0)
        if not (found >= int(value[1:]) if value.startswith("+") else found == int(value)):
            failed.append(item)
    return failed
