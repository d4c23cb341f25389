"""Pixel events of strip, panel and CDT detectors, and one entry for all instruments.

All hits of a packet are dealt to one task by packet_id once; clusters, matching and reducers are windows and sums within
the packet. They take batch DataFrames; a stream runs them in foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import pixels as P
from pulsegrid.functions import validate as V
from pulsegrid.functions.timebase import clock_to_ns, quantised, tof_of, tof_reject
from pulsegrid.operators import cluster as C
from pulsegrid.operators import match as M
from pulsegrid.operators.lookup import lookup
from pulsegrid.sources import decode
from pulsegrid.streaming.pipeline import Settings, caen_events, type_number, vmm_hits

PACKET = ["packet_id", "pulse", "previous", "module"]
CLUSTER = [*PACKET, "plane", "time_cluster", "coord_cluster"]


def clustered_hits(hits: DataFrame, settings: Settings) -> DataFrame:
    """Hits with the time and coordinate cluster of their packet, module and plane (clustering_gap 500 ns, coordinate_gap 0)."""
    o = settings.options
    return C.coord_clusters(hits.repartition("packet_id"), [*PACKET, "plane"], o.get("clustering_gap", 500), o.get("coordinate_gap", 0))


def matched_clusters(clustered: DataFrame, settings: Settings) -> DataFrame:
    """Clusters of both planes with the event they belong to (matching_gap 500 ns)."""
    return M.gap_match(C.cluster_stats(clustered, CLUSTER), PACKET, settings.options.get("matching_gap", 500))


def _placed(rows: DataFrame, settings: Settings, time: Column, rules: V.Rules, pixel: Column) -> DataFrame:
    """Event rows with ``tof``, ``pixel_id`` and the first failing rule, of ``rules``, time of flight and pixel.

    What is used several times is a column of its own, so that generated code stays small.
    """
    c = F.col
    rows = rows.withColumns({"_now": time - c("pulse"), "_before": time - c("previous"), "pixel_id": pixel})
    rows = rows.withColumn("_off", tof_reject(c("_now"), c("_before"), settings.longest_tof_ns))
    reason = F.coalesce(V.first_reject(rules), c("_off"), F.when(c("pixel_id").isNull(), "pixel"))
    return rows.withColumns({"reject_reason": reason, "tof": tof_of(c("_now"), c("_before"), c("_off"))}).drop("_now", "_before", "_off")


def _events(rows: DataFrame) -> DataFrame:
    return V.accepted(rows).select("packet_id", F.col("pulse").alias("reference_time"), "tof", "pixel_id")


def single_plane(rows_a: str = "a_n", rows_b: str = "b_n") -> V.Rules:
    return [("strip_only", F.col(rows_b).isNull()), ("wire_only", F.col(rows_a).isNull())]


def strip_event_rows(packets: DataFrame, settings: Settings, hybrids: DataFrame) -> DataFrame:
    """All events of a Freia packet with tof, pixel_id and reject_reason.

    options: max_gap_wire and max_gap_strip (0; None switches the check off). A plane has a gap if its hits plus the allowed
    gap are fewer than the coordinates that it spans.
    """
    matched = matched_clusters(clustered_hits(vmm_hits(packets, settings, hybrids), settings), settings)
    rules = single_plane()
    for side, name in (("b", "wire"), ("a", "strip")):
        allowed = settings.options.get(f"max_gap_{name}", 0)
        if allowed is not None:
            span = F.col(f"{side}_coord_end") - F.col(f"{side}_coord_start") + 1
            rules.append((f"{name}_gap", C.has_gap(F.col(f"{side}_n"), span, allowed)))
    return _placed(M.events(matched, PACKET), settings, F.col("time_start"), rules, P.vmm_pixel(M.center("a"), M.center("b"), *P.GRIDS["freia"]))


def panel_hits(packets: DataFrame, settings: Settings, hybrids: DataFrame) -> DataFrame:
    """Hits of a panel detector's packets; ``hybrids``: ring, fen, hybrid, panel, plane, offset, reversed, least_adc."""
    good = decode.with_header(packets, type_number("nmx")).where("reject_reason IS NULL")
    rows = V.accepted(decode.readouts(good, "vmm3", ["packet_id", "pulse", "previous"]))
    c, adc = F.col, P.adc10(F.col("otadc"))
    rows = rows.withColumns({"ring": V.ring(c("fiber")), "fen": c("fen").cast("int"), "hybrid": P.vmm_hybrid(c("vmm"))})
    rows = lookup(rows, hybrids, ["ring", "fen", "hybrid"])
    rows = V.accepted(V.with_reject(rows, V.nmx(c("ring"), c("fen"), c("panel"), adc, c("channel"), c("least_adc"))))
    coordinate = P.nmx_coordinate(c("channel"), P.vmm_asic(c("vmm")), c("offset"), c("reversed")).cast("int")
    time = quantised(clock_to_ns(c("time_high"), c("time_low")))
    return rows.select("packet_id", "pulse", "previous", c("panel").alias("module"), "plane", c("pos").alias("seq"), time.alias("time"), coordinate.alias("coordinate"), adc.alias("weight"))


def panel_event_rows(packets: DataFrame, settings: Settings, hybrids: DataFrame) -> DataFrame:
    """All events of a panel detector's packets, placed by the coordinate at the latest time of each plane.

    options: min_span 1, max_span 10 (coordinates) and max_time_span 500 (ns) of each plane. The time of an event is its end.
    """
    o, c = settings.options, F.col
    clustered = clustered_hits(panel_hits(packets, settings, hybrids), settings)
    matched = matched_clusters(clustered, settings)
    rows = M.events(matched, PACKET)
    # a plane's hits stand in the order of its clusters, and by coordinate within each
    named = clustered.join(matched.select(*CLUSTER, "event", "time_start", "time_end"), CLUSTER)
    order = Window.partitionBy(*PACKET, "event", "plane").orderBy("time_start", "time_end", "coord_cluster", "coordinate", "time", "seq")
    latest = M.utpc(named.withColumn("seq", F.row_number().over(order)), [*PACKET, "event", "plane"])
    latest = latest.groupBy(*PACKET, "event").agg(F.max(F.when(c("plane") == 0, c("utpc"))).alias("x"), F.max(F.when(c("plane") == 1, c("utpc"))).alias("y"))
    rules = single_plane()
    for s, name in (("a", "x"), ("b", "y")):
        span, lasts = c(f"{s}_coord_end") - c(f"{s}_coord_start") + 1, c(f"{s}_time_end") - c(f"{s}_time_start") + 1
        rules += [(f"span_max_{name}", span > o.get("max_span", 10)), (f"span_min_{name}", span < o.get("min_span", 1)), (f"time_span_{name}", lasts > o.get("max_time_span", 500))]
    return _placed(rows.join(latest, [*PACKET, "event"]), settings, c("time_end"), rules, P.vmm_pixel(c("x"), c("y"), *P.GRIDS["nmx"]))


# CDT module types of each instrument, with their part and their grid (x, y).
CDT_TYPES = {
    "dream": {"FwEndCap": ("fw_endcap", 280, 256), "BwEndCap": ("bw_endcap", 616, 256), "DreamMantle": ("mantle", 256, 1920), "SANS": ("sans", 112, 3584), "HR": ("hr", 112, 3584)},
    "magic": {"FRDetector": ("fr", 128, 1920), "PADetector": ("pa", 256, 512)},
    "heimdal": {"HeimdalMantle": (None, 144, 2048)},
}


def cdt_grids(modules: DataFrame, detector: str) -> DataFrame:
    """``modules`` with what their type fixes: ``grid`` (nx, ny, first pixel id; null for types of other instruments) and the places of cuboids.

    It is worked out once a module, not once a readout, so that the code generated for readouts stays small enough to be compiled.
    """
    c, kind, types = F.col, F.col("kind"), CDT_TYPES[detector]
    grids = (F.when(kind == name, F.struct(F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.lit(P.PART_OFFSETS.get(part, 0)).alias("first_id"))) for name, (part, nx, ny) in types.items())
    rows = modules.withColumn("grid", F.coalesce(*grids))
    cuboids = [name for name in ("SANS", "HR") if name in types]
    if not cuboids:
        return rows
    place = lambda unit: F.coalesce(*(F.when(kind == name, P.cuboid_place(name.lower(), F.lit(unit), c("first"), c("second"))) for name in cuboids))
    return rows.withColumns({"place0": place(0), "place1": place(1)})


def with_cdt_pixel(rows: DataFrame, detector: str) -> DataFrame:
    """``rows``, joined with cdt_grids, with ``pixel_id`` within the instrument; null for types of other instruments.

    What several columns use (cassette, place, cell, x, y) is a column of its own, so that generated code stays small.
    """
    c = F.col
    kind, first, second, unit, anode, cathode = (c(n) for n in ("kind", "first", "second", "unit", "anode", "cathode"))
    shared = {}
    if "FwEndCap" in CDT_TYPES[detector]:
        shared["cassette"] = P.sumo_cassette(unit, anode, cathode)
    if "place0" in rows.columns:
        shared |= {"place": F.when(unit == 0, c("place0")).when(unit == 1, c("place1"))} | dict(zip(("cell_x", "cell_y"), P.cuboid_cell(anode, cathode)))
    rows = rows.withColumns(shared) if shared else rows
    sumo = lambda: P.sumo_xy(first, unit, c("cassette"), anode, cathode)
    cuboid = lambda: P.turned_xy(c("cell_x"), c("cell_y"), cathode, c("place"))
    built = {
        "FwEndCap": sumo, "BwEndCap": sumo, "DreamMantle": lambda: P.mantle_xy(first, second, anode, cathode), "SANS": cuboid, "HR": cuboid,
        "FRDetector": lambda: P.mantle_xy(first, second, anode, cathode, 128), "PADetector": lambda: P.pa_xy(first, anode, cathode), "HeimdalMantle": lambda: P.heimdal_xy(first, second, anode, cathode),
    }
    cells: dict = {}
    for name in CDT_TYPES[detector]:
        cells.setdefault(built[name], []).append(name)
    cells = {tuple(names): build() for build, names in cells.items()}
    rows = rows.withColumns({n: F.coalesce(*(F.when(kind.isin(*names), xy[i].cast("long")) for names, xy in cells.items())) for i, n in enumerate("xy")})
    pixel = P.pixel2d(c("x"), c("y"), c("grid.nx"), c("grid.ny")) + c("grid.first_id")
    return rows.withColumn("pixel_id", pixel).drop("cassette", "place", "cell_x", "cell_y", "x", "y")


def cdt_event_rows(packets: DataFrame, settings: Settings, modules: DataFrame) -> DataFrame:
    """All readouts of a CDT detector with tof, pixel_id and reject_reason; ``modules``: ring, fen, kind, first, second."""
    good = decode.with_header(packets, type_number(settings.detector)).where("reject_reason IS NULL")
    c = F.col
    rows = V.accepted(decode.readouts(good, "cdt", ["packet_id", "pulse", "previous"]))
    rows = lookup(rows.withColumns({"ring": V.ring(c("fiber")), "fen": c("fen").cast("int")}), cdt_grids(modules, settings.detector), ["ring", "fen"])
    rows = with_cdt_pixel(rows, settings.detector).drop("grid", "place0", "place1")
    return _placed(rows.withColumn("time", clock_to_ns(c("time_high"), c("time_low"))), settings, c("time"), V.cdt(c("ring"), c("fen"), c("kind")), c("pixel_id")).drop("time")


def instrument_events(packets: DataFrame, settings: Settings, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """packet_id, reference_time, tof and pixel_id of an instrument's events; in calibration mode the packets as they are.

    ``tables``: ``hybrids`` of freia and nmx, ``modules`` of dream, magic and heimdal, and those of the tube detectors.
    """
    if settings.raw:
        return packets
    tables, detector = tables or {}, settings.detector
    composed = {"freia": (strip_event_rows, "hybrids"), "nmx": (panel_event_rows, "hybrids"), **dict.fromkeys(CDT_TYPES, (cdt_event_rows, "modules"))}
    if detector not in composed:
        return caen_events(packets, settings, tables)
    build, needed = composed[detector]
    if needed not in tables:
        raise ValueError(f"{detector} needs the table {needed}")
    return _events(build(packets, settings, tables[needed]))
