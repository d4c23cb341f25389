"""File sources: captures of network packets, white-space readout tables, synthetic values and test images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the capture format: magic numbers (byte order, nanoseconds), and bytes before the IP header by link type.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
LINK_BYTES = {1: 14, 0: 4, 101: 0, 113: 16}


def datagrams(raw: bytes) -> Iterator[tuple[int, int, bytes, str]]:
    """(number, ns, payload, status) of each record of a capture; status is ok, not_udp or truncated."""
    if raw[:4] not in MAGIC:
        raise ValueError("not a packet capture")
    order, scale = MAGIC[raw[:4]]
    link = LINK_BYTES.get(struct.unpack_from(order + "I", raw, 20)[0], 14)
    at, number = 24, 0
    while at + 16 <= len(raw):
        seconds, fraction, kept, sent = struct.unpack_from(order + "IIII", raw, at)
        frame = raw[at + 16 : at + 16 + kept]
        at, number, ns = at + 16 + kept, number + 1, seconds * 10**9 + fraction * scale
        if kept < sent or len(frame) < kept:
            yield number, ns, b"", "truncated"
            continue
        ip = frame[link:]
        head = (ip[0] & 15) * 4 if ip else 0
        if len(ip) < head + 8 or ip[0] >> 4 != 4 or ip[9] != 17:
            yield number, ns, b"", "not_udp"
            continue
        size = struct.unpack_from(">H", ip, head + 4)[0]
        yield number, ns, ip[head + 8 : head + size], "ok"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of all capture files: file, number, ns, payload, status. A file is read by one task."""

    def split(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(datagrams(raw))
                for start in range(0, len(rows), 5000):
                    part = rows[start : start + 5000]
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(part), "number": pa.array([r[0] for r in part], pa.int64()), "ns": pa.array([r[1] for r in part], pa.int64()), "payload": pa.array([r[2] for r in part], pa.binary()), "status": [r[3] for r in part]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(split, "file string, number long, ns long, payload binary, status string")


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """White-space readout tables with a header line: ring, fen, time_high, time_low, tube, amp_a, amp_b."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ["ring", "fen", "time_high", "time_low", "tube", "amp_a", "amp_b"]
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d") & (F.size(parts) >= len(names)))
    return lines.select(*(parts[i].cast("long").alias(n) for i, n in enumerate(names)))


def linear(spark: SparkSession, n: int, start: float, slope: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seq"), (F.lit(start) + F.lit(slope) * F.col("id")).alias("value"))


def two_gaussians(x: Column) -> Column:
    """The test density: a floor and two peaks."""
    def normal(m: float, s: float) -> Column:
        return F.exp(-0.5 * F.pow((x - m) / s, 2)) / (s * 2.5066282746310002)

    return 0.001 + normal(30.0, 4.0) + 0.6 * normal(42.0, 4.0)


def sampled(spark: SparkSession, n: int, high: float = 71.0, bins: int = 512, seed: int = 1) -> DataFrame:
    """``n`` values that follow the test density, by inversion of its cumulated histogram of ``bins`` bins."""
    from pyspark.sql import Window

    grid = spark.range(bins).select("id", two_gaussians((F.col("id") + 0.5) * (high / bins)).alias("p"))
    up_to = Window.orderBy("id")  # ``bins`` rows
    cdf = grid.select("id", F.sum("p").over(up_to).alias("c")).withColumn("c", F.col("c") / F.max("c").over(Window.partitionBy()))
    edges = [r["c"] for r in cdf.orderBy("id").collect()]
    table = F.array(*map(F.lit, edges))
    draw = spark.range(n).select(F.col("id").alias("seq"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"))
    at = F.size(F.filter(table, lambda e: e < F.col("u")))
    return draw.select("seq", ((at + F.col("v")) * (high / bins)).alias("value"))


def image_events(spark: SparkSession, image: DataFrame, pulses: int, per_pulse: int) -> DataFrame:
    """Events of a test image (column pixel_id): every pulse emits the first ``per_pulse`` pixels with tof 0, 1, ..."""
    from pyspark.sql import Window

    first = image.orderBy("pixel_id").limit(per_pulse)
    numbered = first.select("pixel_id", (F.row_number().over(Window.orderBy("pixel_id")) - 1).cast("long").alias("tof"))  # per_pulse rows
    slots = spark.range(pulses).select(F.col("id").alias("pulse"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_pulse - 1).cast("long"))).alias("tof"))
    return slots.join(numbered, "tof").select("pulse", "tof", "pixel_id")


def raw_messages(packets: DataFrame, source: str) -> DataFrame:
    """Raw capture messages: source, sequence number from 0 in packet_id order, payload. Packet ids must be unique."""
    from pulsegrid.operators.stream_order import numbered

    return numbered(packets, "packet_id", 100_000, "_rn").select(F.lit(source).alias("source"), (F.col("_rn") - 1).alias("seq"), "payload")
