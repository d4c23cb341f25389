"""Sinks: message tables, hit dumps, monitor messages and metrics lines; Kafka where its connector is on the class path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.histogram import densify, shifted_counts
from pulsegrid.operators.stream_order import event_batches, with_message_ids


def event_messages(events: DataFrame, size: int = 12_400, width: int = 3_600_000_000_000) -> DataFrame:
    """Event messages: source, reference_time, message_id, tof[], pixel_id[]; events of one reference time, ``size`` at most.

    Messages are numbered in slices of ``width`` of the reference time (an hour of nanoseconds).
    """
    batches = event_batches(events, "source", "reference_time", ["tof", "pixel_id"], size, ["tof", "pixel_id"])
    return with_message_ids(batches, "source", "reference_time", width).drop("chunk")


def hit_messages(hits: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Monitor hits in messages of ``size``: arrays of plane, time, coordinate and weight of a module."""
    rows = hits.withColumn("reference_time", F.lit(0).cast("long"))
    return event_batches(rows, "module", "reference_time", order, size, ["plane", "time", "coordinate", "weight"]).drop("reference_time")


def monitor_histograms(hits: DataFrame, strips: int, adc_shift: int, adc_bins: int) -> DataFrame:
    """One row a module: strip counts of both planes, and weight counts of both planes with low bits shifted away."""
    parts = []
    for name, value, shift, bins in (("strips", "coordinate", 0, strips), ("adcs", "weight", adc_shift, adc_bins)):
        for side, plane in (("x", 0), ("y", 1)):
            counts = shifted_counts(hits.where(F.col("plane") == plane), ["module"], value, shift).where(F.col("bin") < bins)
            parts.append(densify(counts.withColumnRenamed("n", f"{side}_{name}"), ["module"], bins, f"{side}_{name}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "module", "full")
    return out


def dump_hits(hits: DataFrame, path: str) -> None:
    """Hits as a Parquet table, one folder a module."""
    hits.write.mode("append").partitionBy("module").parquet(path)


def metric_lines(counters: DataFrame, prefix: str, unix_time: Column) -> DataFrame:
    """``prefix.name value time`` lines of a counters table."""
    return counters.select(F.concat_ws(" ", F.concat(F.lit(prefix + "."), F.col("reason")), F.col("n").cast("string"), unix_time.cast("string")).alias("line"))


def to_kafka(messages: DataFrame, brokers: str, topic: str) -> None:
    """Rows as JSON values keyed by source. Needs Spark's Kafka connector; a stream is written with the same columns."""
    rows = messages.select(F.col("source").alias("key"), F.to_json(F.struct("*")).alias("value"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()
