"""Clock arithmetic as Column expressions. Times are nanoseconds in LONG; TIMESTAMP has only microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value of the clock: ticks in a second.
TICKS = 88_052_500
NS_PER_TICK = 1e9 / TICKS
MAX_TOF_NS = 2**31 - 1


def long(c: Column) -> Column:
    return c.cast("long")


def div(a: Column | str, b: Column | str | int) -> Column:
    """Integer division toward zero."""
    a, b = (F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x for x in (a, b))
    return long((a - a % b) / b)


def clock_to_ns(high: Column, low: Column) -> Column:
    """Seconds and clock ticks to nanoseconds; the fraction of a nanosecond is cut."""
    return long(high) * 1_000_000_000 + long(long(low) * F.lit(NS_PER_TICK))


def ns_to_clock(ns: Column) -> Column:
    """Nanoseconds to (high, low); ticks are rounded, and a full second of ticks is carried."""
    ticks = long(F.round((ns % 1_000_000_000) / F.lit(NS_PER_TICK)))
    second = div(ns, 1_000_000_000)
    carried = F.when(ticks >= TICKS, 1).otherwise(0)
    return F.struct((second + carried).alias("high"), (ticks - carried * TICKS).alias("low"))


def add_ns(high: Column, low: Column, ns: Column) -> Column:
    """(high, low) plus a duration; whole ticks only, with carry."""
    ticks = long(low) + long((ns % 1_000_000_000) / F.lit(NS_PER_TICK))
    carried = F.when(ticks >= TICKS, 1).otherwise(0)
    return F.struct((long(high) + div(ns, 1_000_000_000) + carried).alias("high"), (ticks - carried * TICKS).alias("low"))


def quantised(ns: Column) -> Column:
    """Nanoseconds after a round trip through clock ticks, as strip detectors see their times."""
    there = ns_to_clock(ns)
    return clock_to_ns(there["high"], there["low"])


def tof(time: Column, pulse: Column, previous: Column, longest: int = MAX_TOF_NS) -> Column:
    """(tof, reject): time of flight after the pulse, or after the previous pulse if the event came before the pulse.

    ``longest`` is still accepted. Rejected rows have a null tof and the name of the failing rule.
    """
    now, before = time - pulse, time - previous
    reject = tof_reject(now, before, longest)
    return F.struct(tof_of(now, before, reject).alias("tof"), reject.alias("reject"), (now < 0).alias("from_previous"))


def tof_reject(now: Column, before: Column, longest: int = MAX_TOF_NS) -> Column:
    """Name of the failing rule by the times since the pulse and since the previous pulse."""
    return (
        F.when((now >= 0) & (now > longest), "tof_high")
        .when((now < 0) & (before < 0), "prev_tof_negative")
        .when((now < 0) & (before > longest), "prev_tof_high")
    )


def tof_of(now: Column, before: Column, reject: Column) -> Column:
    return F.when(reject.isNull(), F.when(now >= 0, now).otherwise(before))


def hz_to_ns(hz: Column) -> Column:
    """Period of a frequency, cut to whole nanoseconds; null for 0 Hz."""
    return F.when(hz != 0, long(F.lit(1e9) / hz))
