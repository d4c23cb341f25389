"""Binary packets to rows with built-in expressions only: header fields, readouts, and their error rules.

``strict`` formats (CAEN, CDT, TREX records, beam monitors) give up the rest of a payload at the first bad record; VMM3 skips
bad rows and goes on. Rejected records are counted, not raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timebase import TICKS, div, clock_to_ns
from pulsegrid.functions.validate import first_reject, packet_header, time_source
from pulsegrid.sources.layouts import EVR, HEADER, LAYOUTS, SIZES


def field(data: Column, offset: int | Column, size: int, signed: bool = False) -> Column:
    """A little-endian integer of 1 to 4 bytes at a byte offset, as LONG."""
    text = F.hex(F.substring(data, offset + 1, size))
    swapped = F.concat(*(F.substring(text, 2 * i + 1, 2) for i in reversed(range(size)))) if size > 1 else text
    value = F.conv(swapped, 16, 10).cast("long")
    return F.when(value >= 2 ** (8 * size - 1), value - 2 ** (8 * size)).otherwise(value) if signed else value


def fields(data: Column, layout: list) -> list[Column]:
    return [field(data, offset, size, signed).alias(name) for name, offset, size, signed in layout]


def with_header(packets: DataFrame, expected_type: int, payload: str = "payload") -> DataFrame:
    """``packets`` with ``hdr``, ``data`` (what follows the header), pulse times in ns, and ``reject_reason``."""
    raw = F.col(payload)
    rows = packets.withColumn("hdr", F.struct(*fields(raw, HEADER)))
    size = F.length(raw)
    rows = rows.withColumn("reject_reason", first_reject(packet_header(lambda name: F.col(f"hdr.{name}"), expected_type, size)))
    start = F.when(F.col("hdr.version") == 0, 31).otherwise(33)
    return rows.withColumns({
        "data": raw.substr(start, F.greatest(size - start + 1, F.lit(0))),
        "pulse": clock_to_ns(F.col("hdr.pulse_high"), F.col("hdr.pulse_low")), "previous": clock_to_ns(F.col("hdr.prev_high"), F.col("hdr.prev_low")),
    })


def time_source_flags(source: Column) -> Column:
    """Names of all time-source faults of a packet; any of them rejects it."""
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in time_source(source))))


def _rules(kind: str, monitor: bool = False) -> list[tuple[str, Column]]:
    c = F.col
    size = SIZES[kind]
    frame = [("fiber", c("fiber") > 23), ("fen", c("fen") > (12 if kind == "cdt" else 23)), ("length", c("length") != size)]
    if kind == "vmm3":
        return [
            ("length", c("length") != size), ("fiber", c("fiber") > 23), ("fen", c("fen") > 23), ("time_low", c("time_low") >= TICKS), ("bc", c("bc") > 4095),
            *([] if monitor else [("adc", c("otadc").bitwiseAND(0x7FFF) > 1023)]), ("vmm", c("vmm") > 15), ("channel", c("channel") > 63),
        ]
    if kind == "cbm":
        return [*frame, ("time_low", c("time_low") >= TICKS), ("kind", ~c("kind").between(1, 3))]
    return frame


def readouts(packets: DataFrame, kind: str, keys: list[str], data: str = "data", monitor: bool = False, only_kinds: list[int] | None = None) -> DataFrame:
    """One row a record with ``pos`` and ``reject_reason``; ``keys`` are carried along.

    Null reason: accepted. Strict formats give every record after the first bad one the reason ``after_bad``, and a rest that
    is too short for a record the reason ``truncated``. A VMM3 or beam
    monitor payload whose length is not a whole number of records is one row with reason ``payload_size``.
    """
    size, whole = SIZES[kind], kind in ("vmm3", "cbm")
    length = F.length(data)
    count = div(length, size) if whole else div(length + size - 1, size)
    wrong = (length % size != 0) if whole else F.lit(False)
    positions = F.when(wrong | (count == 0), F.when(wrong, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).otherwise(F.sequence(F.lit(0), count.cast("int") - 1))
    rows = packets.select(*keys, F.col(data).alias("_d"), wrong.alias("_wrong"), F.explode(positions).alias("pos"))
    record = F.col("_d").substr(F.col("pos") * size + 1, F.lit(size))
    rows = rows.select(*keys, "pos", "_wrong", "_d", record.alias("_r")).select(*keys, "pos", "_wrong", "_d", *fields(F.col("_r"), LAYOUTS[kind]))
    rules = _rules(kind, monitor) + ([("kind", ~F.col("kind").isin(only_kinds))] if only_kinds else [])
    short = F.length("_d") - F.col("pos") * size < size
    reason = F.when(F.col("_wrong"), "payload_size").when(short, "truncated").otherwise(first_reject(rules))
    rows = rows.withColumn("reject_reason", reason)
    if kind != "vmm3":
        rows = _after_first_bad(rows, keys)
    return rows.drop("_wrong", "_d")


def _after_first_bad(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Marks what follows a packet's first bad record. One window over the packet's records."""
    from pyspark.sql import Window

    bad = F.min(F.when(F.col("reject_reason").isNotNull(), F.col("pos"))).over(Window.partitionBy(*keys))
    return rows.withColumn("reject_reason", F.when(F.col("pos") > bad, "after_bad").otherwise(F.col("reject_reason")))


def beam_values(rows: DataFrame) -> DataFrame:
    """Beam-monitor rows with the fields of their kind only: position for kind 2, 24-bit value and MCA sum for kind 3."""
    only = lambda name, kind: F.when(F.col("kind") == kind, F.col(name)).alias(name)
    keep = [c for c in rows.columns if c not in ("x", "y", "value24", "mca_sum")]
    return rows.select(*keep, only("x", 2), only("y", 2), only("value24", 3), only("mca_sum", 3))


def normalised(value: Column, mca_sum: Column, enabled: Column) -> Column:
    """Beam-monitor value over its MCA sum, as integers, where that is wanted and possible."""
    return F.when(enabled & (mca_sum != 0), div(value, mca_sum)).otherwise(value)


# Fixed values of the pixel camera's words: (field, first bit, bits).
PIXEL_BITS = [("dcol", 53, 7), ("spix", 47, 6), ("pix", 44, 3), ("toa", 30, 14), ("tot", 20, 10), ("ftoa", 16, 4), ("spidr", 0, 16)]
SCALES = {"dcol": 2, "spix": 4}  # columns come in pairs, and superpixels are four rows high
TDC_BITS = [("tdc_type", 56, 4), ("trigger", 44, 12), ("timestamp", 9, 35), ("stamp", 5, 4)]
PIXEL_WORD, TDC_WORD, TDC_TYPES = 11, 6, (15, 10, 14, 11)


def _bits(word: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(word, first).bitwiseAND(F.lit(2**n - 1).cast("long"))


def camera_words(packets: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Words of camera payloads with ``kind`` pixel, tdc or undefined and their bit fields; EVR payloads give one ``evr`` row."""
    raw = F.col(payload)
    is_evr = (F.length(raw) == 24) & (field(raw, 0, 1) == 1)
    evr = packets.where(is_evr).select(*keys, F.lit(0).alias("pos"), F.lit("evr").alias("kind"), *fields(raw, EVR)[1:])
    n = div(F.length(raw), 8).cast("int")
    words = packets.where(~is_evr & (n > 0)).select(*keys, raw.alias("_d"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    part = F.col("_d").substr(F.col("pos") * 8 + 1, F.lit(8))
    word = F.shiftleft(field(part, 4, 4), 32).bitwiseOR(field(part, 0, 4))
    words = words.select(*keys, "pos", word.alias("word")).withColumn("_top", _bits(F.col("word"), 60, 4))
    tdc = (F.col("_top") == TDC_WORD) & _bits(F.col("word"), 56, 4).isin(*TDC_TYPES)
    words = words.withColumn("kind", F.when(F.col("_top") == PIXEL_WORD, "pixel").when(tdc, "tdc").otherwise("undefined"))
    values = [F.when(F.col("kind") == kind, _bits(F.col("word"), at, n) * SCALES.get(name, 1)).alias(name) for kind, layout in (("pixel", PIXEL_BITS), ("tdc", TDC_BITS)) for name, at, n in layout]
    return words.select(*keys, "pos", "kind", *values).unionByName(evr, allowMissingColumns=True)
