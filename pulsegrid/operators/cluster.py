"""Clustering by gaps (sessionisation) and cluster statistics, as windows and aggregations.

islands() is exact for any key, however many rows it holds: a key's rows are cut into slices of their start value, windows
run within a slice, and what crosses slices (the reach so far, and the island that is still open) is carried by two
windows over one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def islands(df: DataFrame, keys: list[str], start: str, gap: Column | int, end: str | None = None, order: list[str] | None = None, width: int | None = None, name: str = "island") -> DataFrame:
    """``df`` with ``name``: the start value of the row's island within ``keys``.

    Rows are taken by start (ties by ``order``). A row opens an island if its start exceeds the largest end before it by
    more than ``gap``. With ``width``, slices of that many units of the start value are processed in parallel.
    """
    end, order = end or start, order or []
    gap = F.lit(gap) if isinstance(gap, int) else gap
    slices = [*keys, "_slice"]
    sliced = df.withColumn("_slice", F.floor(F.col(start) / width) if width else F.lit(0).cast("long"))
    if width:
        reach = sliced.groupBy(*slices).agg(F.max(end).alias("_last"))
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carry = reach.select(*slices, F.max("_last").over(earlier).alias("_carry"))
        sliced = sliced.join(carry, slices)
    else:
        sliced = sliced.withColumn("_carry", F.lit(None).cast(df.schema[end].dataType if not isinstance(df.schema[end].dataType, LongType) else LongType()))
    before = Window.partitionBy(*slices).orderBy(start, *order)
    previous = before.rowsBetween(Window.unboundedPreceding, -1)
    so_far = before.rowsBetween(Window.unboundedPreceding, 0)
    sliced = sliced.withColumn("_reach", F.greatest(F.max(end).over(previous), "_carry"))
    sliced = sliced.withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap), F.col(start)))
    sliced = sliced.withColumn(name, F.max("_opens").over(so_far))
    if width:
        opened = sliced.groupBy(*slices).agg(F.max("_opens").alias("_open"))
        still = opened.select(*slices, F.last("_open", ignorenulls=True).over(earlier).alias("_still"))
        sliced = sliced.join(still, slices).withColumn(name, F.coalesce(name, "_still")).drop("_still")
    return sliced.drop("_slice", "_carry", "_reach", "_opens")


def time_clusters(hits: DataFrame, keys: list[str], gap: int, width: int | None = None) -> DataFrame:
    """A time cluster ends where the next hit is more than ``gap`` later."""
    return islands(hits, keys, "time", gap, order=["seq"], width=width, name="time_cluster")


def coord_clusters(hits: DataFrame, keys: list[str], time_gap: int, coord_gap: int = 0, width: int | None = None) -> DataFrame:
    """Time clusters, then within each, coordinates more than ``coord_gap`` above the largest so far."""
    timed = time_clusters(hits, keys, time_gap, width)
    return islands(timed, [*keys, "time_cluster"], "coordinate", coord_gap, order=["time", "seq"], name="coord_cluster")


def xz_clusters(hits: DataFrame, keys: list[str], time_gap: int, x_gap: int, z_gap: int, z_range: int, width: int | None = None) -> DataFrame:
    """Time clusters, then islands of x = wire div z_range, then of z = wire mod z_range."""
    timed = time_clusters(hits, keys, time_gap, width)
    placed = timed.withColumns({"x": F.floor(F.col("coordinate") / z_range).cast("long"), "z": (F.col("coordinate") % z_range).cast("long")})
    by_x = islands(placed, [*keys, "time_cluster"], "x", x_gap, order=["time", "seq"], name="x_cluster")
    return islands(by_x, [*keys, "time_cluster", "x_cluster"], "z", z_gap, order=["time", "seq"], name="z_cluster")


def cluster_stats(clustered: DataFrame, keys: list[str], coordinates: tuple[str, ...] = ("coordinate",)) -> DataFrame:
    """Running aggregates of each cluster: sums weighted by weight and by weight squared, bounds, spans and centres.

    The coordinate at the earliest (latest) time is that of the first hit with that time in ``seq`` order.
    """
    w, w2 = F.col("weight"), F.col("weight") * F.col("weight")
    sums = [F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w2).alias("w2"), F.min("time").alias("time_start"), F.max("time").alias("time_end")]
    for c in coordinates:
        tag = "" if c == "coordinate" else f"_{c}"
        sums += [
            F.sum(w * F.col(c)).alias(f"wc{tag}"), F.sum(w2 * F.col(c)).alias(f"w2c{tag}"), F.min(c).alias(f"coord_start{tag}"), F.max(c).alias(f"coord_end{tag}"),
            F.min_by(c, F.struct("time", "seq")).alias(f"coord_earliest{tag}"), F.max_by(c, F.struct("time", -F.col("seq"))).alias(f"coord_latest{tag}"),
        ]
    return clustered.groupBy(*keys).agg(*sums)


def with_centres(stats: DataFrame, tag: str = "") -> DataFrame:
    """Centres of mass and of squared charge (null without weight), and spans that count both ends."""
    return stats.withColumns({
        f"center{tag}": F.try_divide(F.col(f"wc{tag}").cast("double"), F.col("w").cast("double")), f"center2{tag}": F.try_divide(F.col(f"w2c{tag}").cast("double"), F.col("w2").cast("double")),
        "time_span": F.col("time_end") - F.col("time_start") + 1, f"coord_span{tag}": F.col(f"coord_end{tag}") - F.col(f"coord_start{tag}") + 1,
    })


def merge_stats(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Merged clusters: sums and bounds add up; the coordinates at the earliest and latest hit stay the first cluster's."""
    first = lambda c: F.min_by(c, F.struct("time_start", "coord_start")).alias(c)
    return clusters.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("n", "w", "w2", "wc", "w2c")), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"),
        F.min("coord_start").alias("coord_start"), F.max("coord_end").alias("coord_end"), first("coord_earliest"), first("coord_latest"),
    )


def time_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1, F.lit(0))


def time_gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Null (no gap is known) if either side is empty."""
    return F.greatest(F.greatest(a_start, b_start) - F.least(a_end, b_end), F.lit(0))


def has_gap(hits: Column, span: Column, allowed: int) -> Column:
    """True if a cluster has fewer hits, with ``allowed`` more, than its span has coordinates; hits of one coordinate all count."""
    return hits + allowed < span


def chunk_index(x: Column, y: Column, chunk: int, per_dimension: int) -> Column:
    """Spatial chunk of a pixel; clusters never cross chunks."""
    return F.floor(x / chunk) + per_dimension * F.floor(y / chunk)


def seed_clusters(hits: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Greedy clustering around seeds within each group of ``keys`` (a time cluster of a chunk).

    In (time, seq) order an unvisited hit becomes a seed and takes every later unvisited hit nearer than ``gap``. ``seed``
    is the seed's seq. Hits of one pixel share their seed: it is the first near one, and seeds that come later stand behind it.
    So a group's array holds each of its pixels once, at its first hit, and is bounded by the detector however many hits
    there are; a fold over it keeps the seeds, and the hits are joined by pixel. Without x or y a hit is its own seed.
    """
    if gap == 0:
        return hits.select(*keys, "seq", F.col("seq").alias("seed"))
    near = lambda s, h: (s["x"] - h["x"]) * (s["x"] - h["x"]) + (s["y"] - h["y"]) * (s["y"] - h["y"]) < gap * gap
    pixels = hits.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "x", "y").agg(F.min(F.struct("time", "seq")).alias("_f"))
    groups = pixels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_f.time", "_f.seq", "x", "y"))).alias("_pixels"))
    none = F.slice("_pixels", 1, 0)
    seeds = F.aggregate("_pixels", none, lambda acc, h: F.when(F.exists(acc, lambda s: near(s, h)), acc).otherwise(F.concat(acc, F.array(h))))
    found = groups.withColumn("_seeds", seeds).select(*keys, F.explode(F.transform("_pixels", lambda h: F.struct(h["x"].alias("x"), h["y"].alias("y"), F.get(F.filter("_seeds", lambda s: near(s, h)), F.lit(0))["seq"].alias("seed")))).alias("_p"))
    found = found.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"), F.col("_p.seed").alias("seed"))
    on = (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return hits.select(*keys, "seq", "x", "y").join(found, on, "left").select(*keys, "seq", F.coalesce("seed", "seq").alias("seed"))
