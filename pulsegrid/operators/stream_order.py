"""Sequence checks, sampling, merging, batching and metrics over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timebase import div


def _carried(sliced: DataFrame, per_slice: DataFrame, slices: list[str], name: str) -> DataFrame:
    """``sliced`` with the column ``name`` of its slice; null keys are keys like others."""
    renamed = per_slice.select(*(F.col(k).alias(f"_of_{k}") for k in slices), name)
    same = [sliced[k].eqNullSafe(renamed[f"_of_{k}"]) for k in slices]
    return sliced.join(renamed, same, "left").drop(*(f"_of_{k}" for k in slices))


def neighbour(df: DataFrame, keys: list[str], order: list[str], columns: list[str], width: int, ahead: bool = False) -> DataFrame:
    """``df`` with ``beside``: ``columns`` of the row before (``ahead``: after) it within ``keys``, as a struct; null at the end.

    Windows run in slices of ``width`` of the first column of ``order``, a number; between slices one row a slice travels, so
    no key is ordered in one task.
    """
    slices, value = [*keys, "_slice"], F.struct(*columns)
    edge, step = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    sliced = df.withColumn("_slice", F.floor(F.col(order[0]) / width))
    edges = sliced.groupBy(*slices).agg(edge(value, F.struct(*order)).alias("_edge"))
    edges = edges.withColumn("_edge", step("_edge").over(Window.partitionBy(*keys).orderBy("_slice")))
    beside = step(value).over(Window.partitionBy(*slices).orderBy(*order))
    return _carried(sliced.withColumn("beside", beside), edges, slices, "_edge").withColumn("beside", F.coalesce("beside", "_edge")).drop("_slice", "_edge")


def sequence_errors(df: DataFrame, keys: list[str], seq: str, order: list[str], width: int) -> DataFrame:
    """``df`` with ``sequence_error``: the number is not the one after its predecessor's; the first should be 0."""
    expected = F.coalesce(F.col("beside")[seq] + 1, F.lit(0))
    return neighbour(df, keys, order, [seq], width).withColumn("sequence_error", F.col(seq) != expected).drop("beside")


def numbered(df: DataFrame, order: str, width: int, name: str = "rn", keys: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """``df`` with its 1-based rank by ``order``, a LONG (and ``ties``), within ``keys``: windows run in slices of ``width``, offsets over one row a slice."""
    keys = keys or []
    slices = [*keys, "_slice"]
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width))
    sizes = sliced.groupBy(*slices).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*slices, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*slices).orderBy(order, *(ties or [])))
    return _carried(sliced, offsets, slices, "_before").withColumn(name, (F.col("_before") + rank).cast("long")).drop("_slice", "_before")


def sample(df: DataFrame, order: str, period: int, samples: int, width: int) -> DataFrame:
    """``samples`` consecutive rows of every ``period``."""
    return numbered(df, order, width, "_rn").where(F.col("_rn") % period < samples).drop("_rn")


def chrono_merge(df: DataFrame, module: str, time: str, latency: int) -> DataFrame:
    """Rows earlier than the horizon (the least of the modules' latest times) by more than ``latency``; the rest is held."""
    latest = df.groupBy(module).agg(F.max(time).alias("_latest"))
    horizon = latest.agg(F.min("_latest").alias("_horizon"))  # one row
    return df.join(F.broadcast(horizon), F.col(time) < F.col("_horizon") - latency).drop("_horizon")


def event_batches(df: DataFrame, source: str, reference: str, order: list[str], size: int, columns: list[str]) -> DataFrame:
    """Message batches: rows of one source and reference time, ``size`` to a message, as arrays in ``order``."""
    rn = F.row_number().over(Window.partitionBy(source, reference).orderBy(*order))
    rows = df.withColumn("chunk", div(rn.cast("long") - 1, size))
    rows = rows.withColumn("_rn", rn)
    grouped = rows.groupBy(source, reference, "chunk").agg(F.sort_array(F.collect_list(F.struct("_rn", *columns))).alias("_rows"))  # at most ``size`` entries
    return grouped.select(source, reference, "chunk", *(F.col("_rows")[c].alias(c) for c in columns))


def with_message_ids(batches: DataFrame, source: str, reference: str, width: int) -> DataFrame:
    """Messages of a source numbered from 1 in order of reference time and chunk, in slices of ``width`` of the reference time."""
    return numbered(batches, reference, width, "message_id", [source], ["chunk"])


def rates(counters: DataFrame, name: str, time: str, value: str) -> DataFrame:
    """(new - old) / dt between a counter's successive readings."""
    w = Window.partitionBy(name).orderBy(time)
    dt, dv = F.col(time) - F.lag(time).over(w), F.col(value) - F.lag(value).over(w)
    return counters.withColumn("rate", F.try_divide(dv.cast("double"), dt.cast("double")))


def runtime_mask(counters: DataFrame, time: str, index: str, value: str) -> DataFrame:
    """(time, mask): bit i is set if counter i changed since its reading before; the first reading compares with 0. Readings of one time go by value."""
    changed = F.col(value) != F.coalesce(F.lag(value).over(Window.partitionBy(index).orderBy(time, value)), F.lit(0))
    bits = counters.select(time, F.when(changed, F.call_function("shiftleft", F.lit(1), F.col(index).cast("int"))).otherwise(0).alias("_bit"))
    return bits.groupBy(time).agg(F.bit_or("_bit").alias("mask"))


def as_of(left: DataFrame, right: DataFrame, time: str, right_time: str, columns: list[str], width: int, keys: list[str] | None = None, order: str = "seq") -> DataFrame:
    """``left`` with the ``columns`` of the latest ``right`` row at or before its time, within ``keys``.

    One union and one window over slices of ``width``; each slice starts from the last right row of the slices before it.
    """
    keys = keys or []
    payload = F.struct(F.col(right_time).alias(right_time), *columns).alias("_p")
    kinds = right.select(payload).schema["_p"].dataType.simpleString()
    a = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kinds).alias("_p"), F.struct("*").alias("_row"))
    row_kind = a.schema["_row"].dataType.simpleString()
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), payload, F.lit(None).cast(row_kind).alias("_row"))
    both = a.unionByName(b).withColumn("_slice", F.floor(F.col("_t") / width))
    local = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    slices = both.select(*keys, "_slice", "_t", "_p").groupBy(*keys, "_slice").agg(F.max(F.when(F.col("_p").isNotNull(), F.struct("_t", "_p")))["_p"].alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(over).alias("_carry"))
    found = both.withColumn("_found", F.last("_p", ignorenulls=True).over(local)).where("_side = 1").join(carried, [*keys, "_slice"])
    chosen = F.coalesce("_found", "_carry")
    return found.select("_row.*", *(chosen[c].alias(c) for c in [right_time, *columns]))


def counter_gaps(df: DataFrame, keys: list[str], counter: str, order: list[str]) -> DataFrame:
    """(keys, accepted, dropped, missed) of counters that may repeat or go back.

    A reading equal to the last accepted one is dropped, and so is one below it, unless it is 0 or 1 (the counter wrapped);
    gaps are missed. After a reading of 0, 1 or null that value is the last, dropped or not, so it opens a run; in a run the
    last accepted value is the greatest so far. So windows over sorted rows do it, and no group is held as an array.
    """
    by = [*order, "_c"]
    rows = df.select(*keys, *(F.col(c) for c in order if c not in keys), F.col(counter).cast("long").alias("_c"))
    over = Window.partitionBy(*keys).orderBy(*by)
    opens = F.coalesce(F.col("_c").isin(0, 1), F.lit(True)).cast("long")
    rows = rows.withColumn("_run", F.sum(opens).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_last", F.max("_c").over(Window.partitionBy(*keys, "_run").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_last", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_run", *by)))
    bad = F.coalesce((F.col("_c") == F.col("_last")) | ((F.col("_c") < F.col("_last")) & ~F.col("_c").isin(0, 1)), F.lit(False))
    jump = F.when(F.col("_c") > F.col("_last") + 1, F.col("_c") - F.col("_last") - 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("dropped"), F.sum(jump).alias("missed"))
