"""Detector-like views of the supplied tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.timebase import div

MINUTE, DAY = 60_000_000, 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    """Microseconds since the epoch of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, time, coordinate, weight, plane, module from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), micros("ts").alias("time"), (F.col("user_id") % 64).cast("int").alias("coordinate"),
        F.floor("value").cast("int").alias("weight"), (F.col("event_id") % 2).cast("int").alias("plane"), F.col("event_type").alias("module"),
    )


HITS = """hits AS (SELECT event_id AS seq, epoch_us(ts) AS time, CAST(user_id % 64 AS INT) AS coordinate,
 CAST(floor(value) AS INT) AS weight, CAST(event_id % 2 AS INT) AS plane, event_type AS module FROM events)"""


def readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector readouts from lineitem; some fields are out of range."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("packet_id"), c("l_linenumber").alias("line"), (c("l_suppkey") % 26).cast("int").alias("fiber"), (c("l_partkey") % 14).cast("int").alias("fen"),
        c("l_linenumber").cast("int").alias("grp"), c("l_quantity").cast("int").alias("amp_a"), (F.round("l_extendedprice").cast("long") % 512).cast("int").alias("amp_b"),
        F.round(c("l_discount") * 100).cast("int").alias("amp_c"), F.round(c("l_tax") * 100).cast("int").alias("amp_d"), (c("l_partkey") % 64).cast("int").alias("channel"),
        (c("l_suppkey") % 16).cast("int").alias("vmm"), (F.floor("l_extendedprice").cast("long") % 1100).cast("int").alias("adc"), c("l_partkey").alias("partkey"), c("l_suppkey").alias("suppkey"),
        (c("l_partkey") % 128).cast("int").alias("anode"), (c("l_suppkey") * 7 % 128).cast("int").alias("cathode"),
    )


READOUTS = """readouts AS (SELECT l_orderkey AS packet_id, l_linenumber AS line, CAST(l_suppkey % 26 AS INT) AS fiber, CAST(l_partkey % 14 AS INT) AS fen,
 CAST(l_linenumber AS INT) AS grp, CAST(trunc(l_quantity) AS INT) AS amp_a, CAST(CAST(round(l_extendedprice) AS BIGINT) % 512 AS INT) AS amp_b,
 CAST(round(l_discount * 100) AS INT) AS amp_c, CAST(round(l_tax * 100) AS INT) AS amp_d, CAST(l_partkey % 64 AS INT) AS channel,
 CAST(l_suppkey % 16 AS INT) AS vmm, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1100 AS INT) AS adc, l_partkey AS partkey, l_suppkey AS suppkey,
 CAST(l_partkey % 128 AS INT) AS anode, CAST(l_suppkey * 7 % 128 AS INT) AS cathode FROM lineitem)"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the pulse (order date) and the previous pulse (60 days before), all in microseconds."""
    pulses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), micros("o_orderdate").alias("pulse"), F.col("o_orderpriority").alias("source"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", micros("l_shipdate").alias("time"), F.col("l_quantity").cast("int").alias("weight"), F.col("l_suppkey").alias("suppkey"))
    return lines.join(pulses, "l_orderkey").withColumn("previous", F.col("pulse") - 400 * DAY)


TIMED = f"""timed AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS time, CAST(trunc(l_quantity) AS INT) AS weight, l_suppkey AS suppkey,
 epoch_us(o_orderdate) AS pulse, o_orderpriority AS source, epoch_us(o_orderdate) - {400 * DAY} AS previous
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration by group: intervals of 7 units and cubic coefficients, from 24 parts."""
    unit = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("unit")
    rows = table(spark, sf_dir, "part").where("p_partkey < 24").select(F.col("p_partkey").cast("int").alias("grp"), "p_size", unit)
    size = F.col("p_size").cast("double")
    return rows.select("grp", "unit", (F.col("unit") / 7.0).alias("lo"), ((F.col("unit") + 0.9) / 7.0).alias("hi"), (size / 1000).alias("a"), (-size / 2000).alias("b"), (size / 5000).alias("c"), (size / 9000).alias("d"))


INTERVALS = """intervals AS (SELECT CAST(p_partkey AS INT) AS grp, CAST(unit AS INT) AS unit, unit / 7.0::DOUBLE AS lo, (unit + 0.9::DOUBLE) / 7.0::DOUBLE AS hi,
 p_size::DOUBLE / 1000 AS a, -p_size::DOUBLE / 2000 AS b, p_size::DOUBLE / 5000 AS c, p_size::DOUBLE / 9000 AS d
 FROM part, range(7) t(unit) WHERE p_partkey < 24)"""


def sql_div(a: str, b: str) -> str:
    """Integer division toward zero in DuckDB."""
    return f"(({a}) // ({b}))"


__all__ = ["DAY", "HITS", "INTERVALS", "MINUTE", "READOUTS", "TIMED", "div", "hits", "intervals", "micros", "readouts", "sql_div", "table", "timed"]
