"""Matching clusters of two planes into coincident events, event filters and reducers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.cluster import islands


def gap_match(clusters: DataFrame, keys: list[str], gap: int, width: int | None = None) -> DataFrame:
    """A new event begins where a cluster starts more than ``gap`` after the largest end so far."""
    return islands(clusters, keys, "time_start", gap, end="time_end", order=["plane", "time_end"], width=width, name="event")


def overlap_match(clusters: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Clusters that touch or overlap in time belong together."""
    return gap_match(clusters, keys, 0, width)


def end_match(clusters: DataFrame, keys: list[str], delta: int, width: int | None = None) -> DataFrame:
    """A new event begins where a cluster ends more than ``delta`` after the end before."""
    return islands(clusters, keys, "time_end", delta, order=["plane", "time_start"], width=width, name="event")


def center_match(clusters: DataFrame, keys: list[str], gap: int, center: str = "time_center") -> DataFrame:
    """Pairs by cluster centre: an event closes when both planes are filled, a plane repeats, or a cluster is too far off.

    Too far: more than ``gap`` lies between the bounds of the event and those of the next cluster. ``center`` orders the
    clusters (a centre, or ``time_end``); ties go by plane, start and end. An event has at most two clusters, so its bounds
    are those of the cluster before: along a chain of clusters that each could join the one before, every second begins an
    event. Windows over the sorted group do this, and hold no array. Adds ``event``, numbered from 0 within the group.
    """
    over = Window.partitionBy(*keys).orderBy(F.col(center).cast("double"), "plane", "time_start", "time_end")
    before = lambda name: F.lag(name).over(over)
    between = F.greatest("time_start", before("time_start")) - F.least("time_end", before("time_end"))
    joins = (F.col("plane") != before("plane")) & (between <= gap)
    rows = clusters.withColumns({"_i": F.row_number().over(over), "_joins": F.coalesce(joins, F.lit(False))})
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_begins", (F.col("_i") - F.max(F.when(~F.col("_joins"), F.col("_i"))).over(so_far)) % 2 == 0)
    event = F.sum(F.col("_begins").cast("int")).over(so_far) - 1
    return rows.select(*keys, F.col("time_start").cast("long"), F.col("plane").cast("int"), event.cast("int").alias("event"))


def events(matched: DataFrame, keys: list[str]) -> DataFrame:
    """One row an event: sums and bounds of each plane (prefix a for plane 0, b for plane 1); a missing plane is null."""
    columns = []
    for side, plane in (("a", 0), ("b", 1)):
        mine = F.col("plane") == plane
        columns += [F.sum(F.when(mine, F.col(c))).alias(f"{side}_{c}") for c in ("n", "w", "w2", "wc", "w2c")]
        columns += [f(F.when(mine, F.col(c))).alias(f"{side}_{c}") for f, c in ((F.min, "time_start"), (F.max, "time_end"), (F.min, "coord_start"), (F.max, "coord_end"))]
    return matched.groupBy(*keys, "event").agg(F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"), *columns)


def both_planes(event_rows: DataFrame) -> DataFrame:
    return event_rows.where("a_n > 0 AND b_n > 0")


def span_filter(event_rows: DataFrame, least: int, most: int, longest: int) -> DataFrame:
    """Rejects events by coordinate span of either plane or by time span, with the failing rule in reject_reason."""
    span = lambda s: F.col(f"{s}_coord_end") - F.col(f"{s}_coord_start") + 1
    reason = (
        F.when(F.col("a_n").isNull() | F.col("b_n").isNull(), "single_plane")
        .when((span("a") < least) | (span("b") < least), "span_min").when((span("a") > most) | (span("b") > most), "span_max")
        .when(F.col("time_end") - F.col("time_start") + 1 > longest, "time_span")
    )
    return event_rows.withColumn("reject_reason", reason)


def center(side: str, squared: bool = False) -> Column:
    top, bottom = ("w2c", "w2") if squared else ("wc", "w")
    return F.try_divide(F.col(f"{side}_{top}").cast("double"), F.col(f"{side}_{bottom}").cast("double"))


def utpc(clustered: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """(keys, utpc): the coordinate at the latest time, chosen between the first and the last hit with that time.

    Hits stand in insertion order ``seq``. The one nearer its own end of the cluster wins; a tie goes to the larger weight,
    and then to the last. ``weighted`` gives the mean of the hit and its two neighbours, by squared weight.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    whole = Window.partitionBy(*keys)
    rows = clustered.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(whole), "_top": F.max("time").over(whole)})
    w2, w2c = F.col("weight") * F.col("weight"), F.col("weight") * F.col("weight") * F.col("coordinate")
    beside = order.rowsBetween(-1, 1)
    rows = rows.withColumns({"_w2": F.sum(w2).over(beside), "_w2c": F.sum(w2c).over(beside)}).where("time = _top")
    value = F.try_divide(F.col("_w2c").cast("double"), F.col("_w2").cast("double")) if weighted else F.col("coordinate").cast("double")
    one = lambda f: f(F.struct(value.alias("value"), "weight", F.col("_i").alias("i")), "_i")
    ends = rows.groupBy(*keys).agg(one(F.min_by).alias("first"), one(F.max_by).alias("last"), F.max("_n").alias("n"))
    from_start, from_end = F.col("first.i"), F.col("n") - 1 - F.col("last.i")
    first = (from_start < from_end) | ((from_start == from_end) & (F.col("first.weight") > F.col("last.weight")))
    return ends.select(*keys, F.when(first, F.col("first.value")).otherwise(F.col("last.value")).alias("utpc"))


def utpc_uncertainty(clustered: DataFrame, keys: list[str], max_bins: int, weighted: bool = False) -> DataFrame:
    """Mean coordinate of the hits at the end time, and spans: of those (lower), and of the last time bins (upper).

    ``hits_used`` counts the hits at the end time. A limit on the time span has no effect where it is the earlier of the
    cluster's start and such a limit, so there is none.
    """
    end = F.max("time").over(Window.partitionBy(*keys))
    bins = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("time")))
    rows = clustered.withColumns({"_end": end, "_bin": bins})
    last, late = F.col("time") == F.col("_end"), F.col("_bin") <= max_bins
    c, w = F.col("coordinate"), F.col("weight") if weighted else F.lit(1)
    span = lambda which: F.max(F.when(which, c)) - F.min(F.when(which, c)) + 1
    return rows.groupBy(*keys).agg(
        F.max("time").alias("time"), F.try_divide(F.sum(F.when(last, c * w)).cast("double"), F.sum(F.when(last, w)).cast("double")).alias("center"),
        span(last).alias("uncert_lower"), span(late).alias("uncert_upper"), F.count(F.when(last, 1)).alias("hits_used"),
    )


def max_weight_center(clustered: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """Mean coordinate over the hits with the cluster's largest weight."""
    top = F.max("weight").over(Window.partitionBy(*keys))
    rows = clustered.withColumn("_top", top).where("weight = _top")
    w = F.col("weight") if weighted else F.lit(1)
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("coordinate") * w).cast("double"), F.sum(w).cast("double")).alias("center"), F.count("*").alias("hits_used"))


def split_events(hits: DataFrame, keys: list[str], min_span: int = 10, gap: int = 10, low: float = 1.0, high: float = 1.0) -> DataFrame:
    """Parts an event with a wide plane into two: each plane at its coordinate gaps above ``gap``, paired by weight.

    ``hits`` has plane, coordinate, weight and the event in ``keys``. A part of plane 0 fits a part of plane 1 whose weight is
    within low..high times its own; empty parts weigh 0, as does a plane with a third part. Only a pairing counts whose both
    links fit and neither of whose cross links does. Rows: keys, pairing, and the four part weights. Pairings: ``whole`` (no
    wide plane, or two unbroken planes that fit: one event), ``straight``, ``crossed``, ``discarded``.
    """
    in_plane = Window.partitionBy(*keys, "plane").orderBy("coordinate", "seq")
    jump = F.coalesce(F.col("coordinate") - F.lag("coordinate").over(in_plane) > gap, F.lit(False))
    rows = hits.withColumn("_jump", jump.cast("int"))
    rows = rows.withColumn("_part", F.sum("_jump").over(in_plane.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    mine = lambda p, value: F.when(F.col("plane") == p, value)
    weight = lambda p, k: F.when(F.max(mine(p, F.col("_part"))) <= 2, F.sum(mine(p, F.when(F.col("_part") == k, F.col("weight")))))
    span = lambda p: F.max(mine(p, F.col("coordinate"))) - F.min(mine(p, F.col("coordinate"))) + 1
    parts = (F.coalesce(weight(p, k), F.lit(0)).cast("double").alias(f"{s}{k}") for p, s in ((0, "a"), (1, "b")) for k in (1, 2))
    sums = rows.groupBy(*keys).agg(*parts, F.greatest(span(0), span(1)).alias("span"))
    fits = lambda a, b: (F.col(b) >= low * F.col(a)) & (F.col(b) <= high * F.col(a))
    straight = fits("a1", "b1") & fits("a2", "b2") & ~fits("a1", "b2") & ~fits("a2", "b1")
    crossed = fits("a1", "b2") & fits("a2", "b1") & ~fits("a1", "b1") & ~fits("a2", "b2")
    unbroken = straight & (F.col("a2") == 0) & (F.col("b2") == 0)
    pairing = F.when((F.col("span") < min_span) | unbroken, "whole").when(straight, "straight").when(crossed, "crossed").otherwise("discarded")
    return sums.select(*keys, pairing.alias("pairing"), "a1", "a2", "b1", "b2")
