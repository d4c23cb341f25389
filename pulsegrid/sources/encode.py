"""Packets from rows: the inverse of decode, for generators and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.layouts import HEADER, LAYOUTS, SIZES


def little_endian(value: Column, size: int) -> Column:
    text = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit(2 ** (8 * size) - 1).cast("long"))), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(text, 2 * i + 1, 2) for i in reversed(range(size)))))


def record(kind: str, values: dict[str, Column]) -> Column:
    """One binary record; fields that are not given are 0, and the length is right unless given."""
    at, parts = 0, []
    for name, offset, size, _ in LAYOUTS[kind]:
        if offset == at:
            parts.append(little_endian(values.get(name, F.lit(SIZES[kind]) if name == "length" else F.lit(0)), size))
            at += size
    return F.concat(*parts)


def payloads(rows: DataFrame, keys: list[str], order: list[str], rec: Column) -> DataFrame:
    """Records of a packet joined in ``order``; ``keys`` are a packet, so the group is small."""
    grouped = rows.select(*keys, *order, rec.alias("_r")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "_r"))).alias("_rs"))
    return grouped.select(*keys, F.aggregate("_rs", F.expr("X''"), lambda a, x: F.concat(a, x["_r"])).alias("data"))


def with_packet_header(df: DataFrame, values: dict[str, Column], data: str = "data") -> DataFrame:
    """``df`` with ``payload``: a version-0 header before the data."""
    full = {"cookie": F.lit(0x535345), "total_length": F.length(data) + 30} | values
    return df.withColumn("payload", F.concat(*(little_endian(full.get(name, F.lit(0)), size) for name, _, size, _ in HEADER), F.col(data)))
