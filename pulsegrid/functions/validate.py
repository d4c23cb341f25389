"""Ordered rejection rules: the first failing rule names the reason; counters are a grouped count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timebase import TICKS

Rules = list[tuple[str, Column]]


def first_reject(rules: Rules) -> Column:
    """Name of the first rule whose condition holds, else null."""
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules))


def with_reject(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("reject_reason", first_reject(rules))


def accepted(df: DataFrame) -> DataFrame:
    return df.where("reject_reason IS NULL").drop("reject_reason")


def counters(df: DataFrame) -> DataFrame:
    """(reason, n) with accepted rows under ``ok``; one pre-aggregated row a reason and task is shuffled."""
    return df.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def ring(fiber: Column) -> Column:
    """Two fibres make a ring."""
    return F.floor(fiber / 2).cast("int")


def ring_fen(ring_: Column, fen: Column, max_ring: int, max_fen: int) -> Rules:
    """Both limits are inclusive."""
    return [("ring", ~ring_.between(0, max_ring)), ("fen", ~fen.between(0, max_fen))]


def group(g: Column, max_group: int) -> Rules:
    return [("group", ~g.between(0, max_group))]


def amplitude_zero(a: Column, b: Column) -> Rules:
    return [("amplitude_zero", a + b == 0)]


def amplitude_high(a: Column, b: Column, most: int) -> Rules:
    return [("amplitude_high", a + b > most)]


def amplitude_low(a: Column, b: Column, least: int) -> Rules:
    return [("amplitude_low", (a < least) | (b < least))]


def bifrost(fiber: Column, fen: Column, g: Column, a: Column, b: Column, max_ring: int = 2, max_fen: int = 0, max_group: int = 14, max_amplitude: int = 32767) -> Rules:
    return ring_fen(ring(fiber), fen, max_ring, max_fen) + group(g, max_group) + amplitude_zero(a, b) + amplitude_high(a, b, max_amplitude)


def miracles(fiber: Column, a: Column, b: Column, max_ring: int = 3, max_amplitude: int = 32767) -> Rules:
    return [("ring", ~ring(fiber).between(0, max_ring)), *amplitude_zero(a, b), *amplitude_high(a, b, max_amplitude)]


def cspec(fiber: Column, fen: Column, g: Column, max_ring: int = 11, max_fen: int = 11, max_group: int = 23) -> Rules:
    return ring_fen(ring(fiber), fen, max_ring, max_fen) + group(g, max_group)


def tbl3he(fiber: Column, g: Column, bank: Column, a: Column, b: Column, max_ring: int = 11, max_group: int = 3, least: int = 10) -> Rules:
    """``bank`` is null where the topology has no entry."""
    return [("ring", ~ring(fiber).between(0, max_ring)), *group(g, max_group), ("topology", bank.isNull()), *amplitude_low(a, b, least), *amplitude_zero(a, b)]


def loki(fiber: Column, fen: Column, bank: Column, bank_fens: Column) -> Rules:
    """``bank`` and ``bank_fens`` come from the ring's row of the bank table."""
    return [("ring", ring(fiber) >= 12), ("bank", bank.isNull()), ("fen", fen >= bank_fens)]


def cdt(ring_: Column, fen: Column, kind: Column, max_ring: int = 11, max_fen: int = 11, compat: bool = False) -> Rules:
    """``kind`` is the configured module type. With ``compat`` the last ring and the last FEN have no mapping."""
    unmapped = kind.isNull() | ((ring_ >= max_ring) | (fen >= max_fen) if compat else F.lit(False))
    return ring_fen(ring_, fen, max_ring, max_fen) + [("mapping", unmapped)]


def beam_monitor(ring_: Column, fen: Column, monitor_ring: int, max_fen: int, source: Column, kind: Column, configured: Column, x: Column, y: Column, nx: Column, ny: Column) -> Rules:
    return [
        ("ring", ~ring_.between(0, 11)), ("monitor_ring", ring_ != monitor_ring), ("fen", ~fen.between(0, max_fen)),
        ("topology", source.isNull()), ("type", kind != configured), ("x", (kind == 2) & (x >= nx)), ("y", (kind == 2) & (y >= ny)),
    ]


def vmm_channel(vmm: Column, channel: Column, y_is_wire: bool = True) -> Column:
    """True for a wire channel in 16..47 or a strip channel below 64; odd VMMs read the X plane (strips)."""
    strip = vmm % 2 == 1
    wire = ~strip if y_is_wire else strip
    return F.when(wire, channel.between(16, 47)).otherwise(channel.between(0, 63))


def vmm_family(ring_: Column, fen: Column, hybrid_id: Column, vmm: Column, channel: Column, max_ring: int = 11, max_fen: int = 11) -> Rules:
    """Freia, AMOR, Estia: ring, FEN, initialised hybrid, channel."""
    return [*ring_fen(ring_, fen, max_ring, max_fen), ("hybrid", hybrid_id.isNull()), ("channel", ~vmm_channel(vmm, channel))]


def adc_threshold(otadc: Column, threshold: Column) -> Rules:
    """The raw value counts, over-threshold bit included."""
    return [("adc_threshold", otadc < threshold)]


def nmx(ring_: Column, fen: Column, hybrid_id: Column, adc: Column, channel: Column, least_adc: int, max_ring: int = 11, max_fen: int = 11) -> Rules:
    return [*ring_fen(ring_, fen, max_ring, max_fen), ("hybrid", hybrid_id.isNull()), ("adc", adc < least_adc), ("channel", channel >= 64)]


def trex(hybrid_id: Column, adc: Column, least_adc: Column, coordinate: Column) -> Rules:
    return [("hybrid", hybrid_id.isNull()), ("adc", adc < least_adc), ("mapping", coordinate.isNull())]


def timepix(x: Column, y: Column, nx: int, ny: int, scale: int, global_time: Column) -> Rules:
    return [("x", x >= nx * scale), ("y", y >= ny * scale), ("no_global_time", global_time.isNull())]


def time_source(source: Column) -> Rules:
    """Faults of the time-source byte: a sync source or a timing status without a time source, and fibres out of sync."""
    bit = lambda value: source.cast("int").bitwiseAND(value) != 0
    return [("sync_source", ~bit(1) & bit(2)), ("timing_status", ~bit(1) & bit(8)), ("even_fibre_sync", bit(32)), ("odd_fibre_sync", bit(128))]


def packet_header(h, expected_type: int, size: Column, longest_ns: int = 5 * 71_428_571) -> Rules:
    """Header rules in order. ``h`` gives a header field as a Column by name; ``size`` is the payload's length."""
    from pulsegrid.functions.timebase import clock_to_ns

    pulse, previous = clock_to_ns(h("pulse_high"), h("pulse_low")), clock_to_ns(h("prev_high"), h("prev_low"))
    return [
        ("empty", size.isNull() | (size == 0)),
        ("size", (size < 5) | (size > 8972)),
        ("pad", h("pad") != 0),
        ("version", ~h("version").isin(0, 1)),
        ("cookie", h("cookie") != 0x535345),
        ("header", size < F.when(h("version") == 0, 30).otherwise(32)),
        ("length", size != h("total_length")),
        ("type", h("type") != expected_type),
        ("queue", h("queue") >= 12),
        *time_source(h("time_source")),
        ("pulse_ticks", h("pulse_low") >= TICKS),
        ("prev_ticks", h("prev_low") >= TICKS),
        ("pulse_gap", pulse - previous > longest_ns),
    ]


def any_reject(rules: Rules) -> Column:
    return reduce(lambda a, b: a | b, (bad for _, bad in rules))
