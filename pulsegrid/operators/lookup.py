"""Lookups in configuration tables: hash joins, closed intervals kept as arrays, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.pixels import cubic


def lookup(rows: DataFrame, config: DataFrame, keys: list[str], most_rows: int = 100_000) -> DataFrame:
    """Left join with a configuration table; nulls where it has no entry.

    The table is broadcast if it has at most ``most_rows`` rows (counted up to that number); a larger one is
    joined by shuffle.
    """
    small = config.limit(most_rows + 1).count() <= most_rows
    return rows.join(F.broadcast(config) if small else config, keys, "left")


def missing(rows: DataFrame, config: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(config.select(*keys).distinct(), keys, "left_anti")


def interval_table(intervals: DataFrame, key: str) -> DataFrame:
    """One row a key with its intervals as an array in unit order: no range join is needed."""
    others = [c for c in intervals.columns if c != key]
    return intervals.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("unit", *(c for c in others if c != "unit")))).alias("units"))


def interval_of(units: Column, position: Column) -> Column:
    """The first unit, in unit order, whose closed interval holds the position; null if none does."""
    return F.get(F.filter(units, lambda u: (u["lo"] <= position) & (position <= u["hi"])), F.lit(0))


def corrected(found: Column, position: Column) -> Column:
    """Position after the unit's cubic correction, clamped to 0..1; null where no unit was found."""
    raw = cubic(position, found["a"], found["b"], found["c"], found["d"])
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def overlapping_intervals(intervals: DataFrame, key: str, epsilon: float = 1e-5) -> DataFrame:
    """Intervals that begin before, or within ``epsilon`` of, the end of an earlier one of their key: touching counts."""
    earlier = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("before", F.max("hi").over(earlier)).where(F.col("lo") - F.col("before") < epsilon).drop("before")


def repeated_coordinates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates that more than one hybrid claims; must be empty in a sound configuration."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
