"""Histograms and frame aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timebase import div


def bin_index(t: Column, low: int, period: int, bins: int, last_bin: bool = False) -> Column:
    """Fixed-width bin of ``t``: cut toward zero, null below ``low``; beyond the last bin null, or the last bin."""
    index = div(t - low, (period - low) // bins)
    return F.when(t < low, None).when(index >= bins, F.lit(bins - 1) if last_bin else None).otherwise(index).cast("int")


def edges(low: int, period: int, bins: int) -> list[int]:
    """Bin edges, one more than bins; the step is a whole number."""
    return [low + i * ((period - low) // bins) for i in range(bins + 1)]


def histogram(df: DataFrame, keys: list[str], t: str, low: int, period: int, bins: int, value: str | None = None, last_bin: bool = False) -> DataFrame:
    """(keys, bin, n, total) for bins that hold something."""
    total = F.sum(value) if value else F.count("*")
    return df.withColumn("bin", bin_index(F.col(t), low, period, bins, last_bin)).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count("*").alias("n"), total.alias("total"))


def frame_groups(df: DataFrame, keys: list[str], pulse: str, frames: int, every: DataFrame | None = None) -> DataFrame:
    """``df`` with ``frame_group``: distinct pulses of a key in order, ``frames`` to a group.

    Only distinct pulses are ranked, so the window runs over one row a pulse.
    """
    pulses = (every if every is not None else df).select(*keys, pulse).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(pulse)) - 1
    return df.join(pulses.withColumn("frame_group", div(rank.cast("long"), frames)), [*keys, pulse])


def frame_histogram(df: DataFrame, keys: list[str], pulse: str, t: str, low: int, period: int, bins: int, frames: int, value: str | None = None, mean: bool = False, last_bin: bool = False) -> DataFrame:
    """Histograms over groups of pulses: sums, or integer means (sum div count)."""
    counts = histogram(frame_groups(df, keys, pulse, frames), [*keys, "frame_group"], t, low, period, bins, value, last_bin)
    return counts.withColumn("signal", div(F.col("total"), F.col("n")) if mean else F.col("total")).drop("total")


def densify(counts: DataFrame, keys: list[str], bins: int, value: str = "signal") -> DataFrame:
    """One row a key with an array of all bins; empty bins are 0. Keys without any filled bin have no row."""
    entries = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", value))).alias("_m"))  # at most ``bins`` entries
    return entries.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("_m", i.cast("int")), F.lit(0))).alias(value))


def frame_messages(df: DataFrame, keys: list[str], pulse: str, t: str, low: int, period: int, bins: int, frames: int) -> DataFrame:
    """One message a key and group of pulses: frame_time edges, signal, reference_time offsets and frame_total by pulse.

    Offsets count from the group's first pulse. Messages without any binned value are left out; frame_total counts
    binned values only.
    """
    grouped = frame_groups(df, keys, pulse, frames).withColumn("bin", bin_index(F.col(t), low, period, bins))
    signal = densify(grouped.where("bin IS NOT NULL").groupBy(*keys, "frame_group", "bin").agg(F.count("*").alias("signal")), [*keys, "frame_group"], bins)
    totals = grouped.groupBy(*keys, "frame_group", pulse).agg(F.count("bin").alias("total"))
    series = totals.groupBy(*keys, "frame_group").agg(F.sort_array(F.collect_list(F.struct(pulse, "total"))).alias("_s"))  # at most ``frames`` entries
    parts = series.select(*keys, "frame_group", F.element_at("_s", -1)[pulse].alias("message_time"), F.transform("_s", lambda s: s[pulse] - F.col("_s")[0][pulse]).alias("reference_time"), F.transform("_s", lambda s: s["total"]).alias("frame_total"))
    return signal.join(parts, [*keys, "frame_group"]).withColumn("frame_time", F.array(*map(F.lit, edges(low, period, bins))))


def shifted_counts(df: DataFrame, keys: list[str], value: str, shift: int, skip_zero: bool = False) -> DataFrame:
    """Counts by value with its low bits shifted away."""
    rows = df.where(F.col(value) != 0) if skip_zero else df
    return rows.groupBy(*keys, F.shiftright(F.col(value).cast("int"), shift).alias("bin")).agg(F.count("*").alias("n"))
