"""Queries: time, validation, calibration, pixel ids, histograms, ordering, batching and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import pixels as P
from pulsegrid.functions import timebase as T
from pulsegrid.functions import validate as V
from pulsegrid.operators import histogram as H
from pulsegrid.operators import lookup as L
from pulsegrid.operators import stream_order as S
from pulsegrid.plans.catalog import query
from pulsegrid.plans.fixtures import DAY, HITS, INTERVALS, READOUTS, TIMED, hits, intervals, readouts, table, timed
from pulsegrid.sources import decode, encode

c = F.col
RO, TI = "WITH " + READOUTS, "WITH " + TIMED
LONGEST = 300 * DAY

# time of flight ------------------------------------------------------------------------------------------------------------
TOF = TI + f""", f AS (SELECT *, time - pulse AS now, time - previous AS before FROM timed), t AS (SELECT *, CASE WHEN now >= 0 AND now > {LONGEST} THEN 'tof_high' WHEN now < 0 AND before < 0 THEN 'prev_tof_negative' WHEN now < 0 AND before > {LONGEST} THEN 'prev_tof_high' END AS reject FROM f)"""


def _tof(spark, d):
    return timed(spark, d).withColumn("t", T.tof(c("time"), c("pulse"), c("previous"), LONGEST))


@query("tof", TOF + " SELECT l_orderkey, l_linenumber, CASE WHEN reject IS NULL THEN CASE WHEN now >= 0 THEN now ELSE before END END AS tof, reject, now < 0 AS from_previous FROM t")
def tof(spark, d):
    return _tof(spark, d).select("l_orderkey", "l_linenumber", "t.tof", "t.reject", "t.from_previous")


@query("tof_counters", TOF + " SELECT coalesce(reject, 'ok') AS reason, count(*) AS n FROM t GROUP BY ALL")
def tof_counters(spark, d):
    return V.counters(_tof(spark, d).select(c("t.reject").alias("reject_reason")))


@query("clock_roundtrip", """WITH t AS (SELECT o_orderkey, epoch_us(o_orderdate) * 1000 + o_orderkey * 104729 AS ns FROM orders), e AS (SELECT *, ns // 1000000000 AS high0, CAST(round((ns % 1000000000) / (1e9::DOUBLE / 88052500)) AS BIGINT) AS tick FROM t),
 f AS (SELECT *, high0 + CASE WHEN tick >= 88052500 THEN 1 ELSE 0 END AS high, tick - CASE WHEN tick >= 88052500 THEN 88052500 ELSE 0 END AS low FROM e)
 SELECT o_orderkey, high, low, high * 1000000000 + CAST(trunc(low * (1e9::DOUBLE / 88052500)) AS BIGINT) AS ns FROM f""")
def clock_roundtrip(spark, d):
    from pulsegrid.plans.fixtures import micros

    rows = table(spark, d, "orders").select("o_orderkey", T.ns_to_clock(micros("o_orderdate") * 1000 + c("o_orderkey") * 104729).alias("e"))
    return rows.select("o_orderkey", "e.high", "e.low", T.clock_to_ns(c("e.high"), c("e.low")).alias("ns"))


# validation ----------------------------------------------------------------------------------------------------------------
def _validated(spark, d):
    r = readouts(spark, d)
    return V.with_reject(r, [*V.ring_fen(V.ring(c("fiber")), c("fen"), 11, 11), *V.group(c("grp"), 5), *V.amplitude_zero(c("amp_a"), c("amp_b")), *V.amplitude_low(c("amp_a"), c("amp_b"), 5), *V.amplitude_high(c("amp_a"), c("amp_b"), 500)])


REJECT = RO + """, v AS (SELECT *, CASE WHEN NOT fiber // 2 BETWEEN 0 AND 11 THEN 'ring' WHEN NOT fen BETWEEN 0 AND 11 THEN 'fen' WHEN NOT grp BETWEEN 0 AND 5 THEN 'group' WHEN amp_a + amp_b = 0 THEN 'amplitude_zero' WHEN amp_a < 5 OR amp_b < 5 THEN 'amplitude_low' WHEN amp_a + amp_b > 500 THEN 'amplitude_high' END AS reject_reason FROM readouts)"""


@query("validate_first_reject", REJECT + " SELECT packet_id, line, fiber, fen, reject_reason FROM v")
def validate_first_reject(spark, d):
    return _validated(spark, d).select("packet_id", "line", "fiber", "fen", "reject_reason")


@query("reject_counters", REJECT + " SELECT coalesce(reject_reason, 'ok') AS reason, count(*) AS n FROM v GROUP BY ALL")
def reject_counters(spark, d):
    return V.counters(_validated(spark, d))


@query("vmm_channel_filter", RO + " SELECT packet_id, line, CASE WHEN NOT fiber // 2 BETWEEN 0 AND 11 THEN 'ring' WHEN NOT fen BETWEEN 0 AND 11 THEN 'fen' WHEN vmm // 2 > 5 THEN 'hybrid' WHEN vmm % 2 = 0 AND NOT channel BETWEEN 16 AND 47 THEN 'channel' END AS reject_reason FROM readouts")
def vmm_channel_filter(spark, d):
    r = readouts(spark, d)
    hybrid = F.when(P.vmm_hybrid(c("vmm")) <= 5, P.vmm_hybrid(c("vmm")))
    return V.with_reject(r, V.vmm_family(V.ring(c("fiber")), c("fen"), hybrid, c("vmm"), c("channel"))).select("packet_id", "line", "reject_reason")


# lookups and calibration -----------------------------------------------------------------------------------------------------
def _topology(spark, d):
    return table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select((c("s_suppkey") % 26).cast("int").alias("fiber"), (c("s_suppkey") % 14).cast("int").alias("fen"), c("s_nationkey").alias("bank")).groupBy("fiber", "fen").agg(F.min("bank").alias("bank"))


TOPOLOGY = ", topo AS (SELECT CAST(s_suppkey % 26 AS INT) AS fiber, CAST(s_suppkey % 14 AS INT) AS fen, min(s_nationkey) AS bank FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1, 2)"


@query("topology_lookup", RO + TOPOLOGY + " SELECT packet_id, line, bank, bank IS NULL AS missing FROM readouts LEFT JOIN topo USING (fiber, fen)")
def topology_lookup(spark, d):
    return L.lookup(readouts(spark, d), _topology(spark, d), ["fiber", "fen"]).select("packet_id", "line", "bank", c("bank").isNull().alias("missing"))


@query("topology_missing", RO + TOPOLOGY + " SELECT packet_id, line FROM readouts ANTI JOIN topo USING (fiber, fen)")
def topology_missing(spark, d):
    return L.missing(readouts(spark, d), _topology(spark, d), ["fiber", "fen"]).select("packet_id", "line")


def _located(spark, d):
    r = readouts(spark, d).where("amp_a + amp_b > 0").withColumns({"grp": (c("partkey") % 24).cast("int"), "p": c("amp_a").cast("double") / (c("amp_a") + c("amp_b"))})
    return L.lookup(r, L.interval_table(intervals(spark, d), "grp"), ["grp"]).withColumn("u", L.interval_of(c("units"), c("p")))


LOCATED = RO + ", " + INTERVALS + """, p AS (SELECT packet_id, line, suppkey, CAST(partkey % 24 AS INT) AS grp, amp_a::DOUBLE / (amp_a + amp_b) AS p, amp_a, amp_b, amp_c, amp_d, row_number() OVER () AS rid FROM readouts WHERE amp_a + amp_b > 0),
 m AS (SELECT p.rid, min(unit) AS unit FROM p JOIN intervals i ON p.grp = i.grp AND p.p BETWEEN i.lo AND i.hi GROUP BY p.rid), u AS (SELECT p.*, i.unit, i.lo, i.hi, i.a, i.b, i.c, i.d FROM p LEFT JOIN m USING (rid) LEFT JOIN intervals i ON i.grp = p.grp AND i.unit = m.unit)"""


@query("interval_lookup", LOCATED + " SELECT packet_id, line, grp, p, unit FROM u")
def interval_lookup(spark, d):
    return _located(spark, d).select("packet_id", "line", "grp", "p", "u.unit")


@query("poly_correction", LOCATED + " SELECT packet_id, line, unit, CASE WHEN unit IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, p - (a + p * (b + p * (c + p * d))))) END AS corrected FROM u")
def poly_correction(spark, d):
    return _located(spark, d).select("packet_id", "line", "u.unit", L.corrected(c("u"), c("p")).alias("corrected"))


@query("adc_tdc_calibration", RO + ", k AS (SELECT p_partkey AS channel, p_size / 100.0::DOUBLE AS off, 1 + p_size / 1000.0::DOUBLE AS slope FROM part WHERE p_partkey < 64) SELECT packet_id, line, CAST(trunc(greatest(0.0::DOUBLE, least(1023.0::DOUBLE, ((adc & 1023) - off) * slope))) AS INT) AS adc, ((1.5::DOUBLE * 22.72::DOUBLE) - 60.0::DOUBLE * (suppkey % 256) / 255.0::DOUBLE - off) * slope AS tdc FROM readouts JOIN k USING (channel)")
def adc_tdc_calibration(spark, d):
    size = c("p_size")
    k = table(spark, d, "part").where("p_partkey < 64").select(c("p_partkey").cast("int").alias("channel"), (size / 100.0).alias("off"), (1 + size / 1000.0).alias("slope"))
    r = readouts(spark, d).join(F.broadcast(k), "channel")  # at most 64 rows
    return r.select("packet_id", "line", P.adc_correction(P.adc10(c("adc")), c("off"), c("slope")).alias("adc"), P.tdc_correction(c("suppkey") % 256, c("off"), c("slope")).alias("tdc"))


@query("interval_overlap_check", "WITH i AS (SELECT p_brand AS brand, p_partkey, p_size / 50.0::DOUBLE AS lo, (p_size + 1) / 50.0::DOUBLE AS hi FROM part), w AS (SELECT *, max(hi) OVER (PARTITION BY brand ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i) SELECT brand, count(*) AS overlapping FROM w WHERE lo - before < 1e-5 GROUP BY brand")
def interval_overlap_check(spark, d):
    i = table(spark, d, "part").select(c("p_brand").alias("brand"), (c("p_size") / 50.0).alias("lo"), ((c("p_size") + 1) / 50.0).alias("hi"))
    return L.overlapping_intervals(i, "brand").groupBy("brand").agg(F.count("*").alias("overlapping"))


@query("coord_disjoint_check", "SELECT p_brand AS panel, p_size % 2 AS plane, p_size AS coordinate, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def coord_disjoint_check(spark, d):
    rows = table(spark, d, "part").select(c("p_brand").alias("panel"), (c("p_size") % 2).alias("plane"), c("p_size").alias("coordinate"))
    return L.repeated_coordinates(rows, ["panel", "plane", "coordinate"])


# pixel ids -------------------------------------------------------------------------------------------------------------------
def _grid(x: str, y: str, nx: int, ny: int) -> str:
    return f"CASE WHEN {x} >= 0 AND {x} < {nx} AND {y} >= 0 AND {y} < {ny} THEN CAST({x} + ({y}) * {nx} + 1 AS BIGINT) END"


def _pixels(name: str, xy: tuple[str, str, int, int], build, source: str = RO, relation: str = "readouts"):
    """Register a pixel query from its x and y in SQL and the same as Columns."""

    @query(name, f"{source}, xy AS (SELECT packet_id, line, {xy[0]} AS x, {xy[1]} AS y FROM {relation}) SELECT packet_id, line, {_grid('x', 'y', xy[2], xy[3])} AS pixel_id FROM xy")
    def run(spark, d):
        return build(spark, d).select("packet_id", "line", "pixel_id")

    return run


_on = lambda column: lambda spark, d: readouts(spark, d).withColumn("pixel_id", column())
_pixels("pixel_cspec", ("(fiber // 2) * 75 + (grp % 24) * 3", "CASE WHEN amp_a + amp_b <> 0 THEN (74 * amp_a) // (amp_a + amp_b) END", 900, 180), _on(lambda: P.cspec(V.ring(c("fiber")), c("grp"), c("amp_a"), c("amp_b"))))
_pixels("pixel_bifrost", ("((fiber // 2) % 3) * 300 + (grp % 3) * 100 + CAST(trunc((p - lo) / (hi - lo) * 99) AS BIGINT)", "(grp // 3) * 3 + unit % 3", 900, 15),
        lambda spark, d: _bifrost(spark, d), LOCATED.replace("SELECT packet_id, line, suppkey,", "SELECT packet_id, line, suppkey, fiber,").replace("CAST(partkey % 24 AS INT) AS grp", "CAST(partkey % 15 AS INT) AS grp"), "u")


def _bifrost(spark, d):
    r = readouts(spark, d).where("amp_a + amp_b > 0").withColumns({"grp": (c("partkey") % 15).cast("int"), "p": c("amp_a").cast("double") / (c("amp_a") + c("amp_b"))})
    r = L.lookup(r, L.interval_table(intervals(spark, d), "grp"), ["grp"]).withColumn("u", L.interval_of(c("units"), c("p")))
    relative = (c("p") - c("u.lo")) / (c("u.hi") - c("u.lo"))
    return r.withColumn("pixel_id", P.bifrost(V.ring(c("fiber")) % 3, c("grp"), c("u.unit") % 3, relative))


_REL = "((p - lo) / (hi - lo))"  # the correction is of the position within the unit


def _tbl3he(spark, d):
    r = _located(spark, d)
    relative = (c("p") - c("u.lo")) / (c("u.hi") - c("u.lo"))
    return r.withColumn("pixel_id", P.tbl3he(c("suppkey") % 2, c("line") % 4, L.corrected(c("u"), relative)))


_pixels("pixel_tbl3he", (f"CAST(trunc(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_REL} - (a + {_REL} * (b + {_REL} * (c + {_REL} * d))))) * 99) AS BIGINT)", "CASE WHEN unit IS NOT NULL THEN (suppkey % 2) * 4 + line % 4 END", 100, 8), _tbl3he, LOCATED, "u")


def _loki(spark, d):
    r = readouts(spark, d).withColumn("total", c("amp_a") + c("amp_b") + c("amp_c") + c("amp_d")).where("total > 0")
    position, straw = (c("amp_a") + c("amp_b")).cast("double") / c("total"), (c("amp_b") + c("amp_d")).cast("double") / c("total")
    unit = F.least((straw * 7).cast("long"), F.lit(6))
    return r.withColumn("pixel_id", P.loki(F.lit(0), F.lit(8), F.lit(2), c("fen"), c("grp"), unit, position, 512, 56))


_pixels("pixel_loki", ("CAST(round((amp_a + amp_b)::DOUBLE / (amp_a + amp_b + amp_c + amp_d) * 511) AS BIGINT)", "(grp % 4) * 56 + (2 + fen) * 14 + 7 * (grp // 4) + least(CAST(trunc((amp_b + amp_d)::DOUBLE / (amp_a + amp_b + amp_c + amp_d) * 7) AS BIGINT), 6)", 512, 392), _loki, RO, "readouts WHERE amp_a + amp_b + amp_c + amp_d > 0")


@query("pixel_miracles", RO + """, p AS (SELECT packet_id, line, fiber // 2 AS ring, grp, amp_a, amp_b, (amp_a::DOUBLE / (amp_a + amp_b))::FLOAT::DOUBLE AS p FROM readouts WHERE amp_a + amp_b > 0),
 xy AS (SELECT packet_id, line, 2 * grp + CASE WHEN ring IN (1, 3) THEN 24 ELSE 0 END + CASE WHEN amp_a >= amp_b THEN 0 ELSE 1 END AS x, CASE WHEN amp_a >= amp_b THEN CAST(round(63 - (p - 0.5::DOUBLE) * 2 * 63) AS BIGINT) ELSE CAST(trunc(p * 2 * 63) AS BIGINT) END + CASE WHEN ring IN (2, 3) THEN 64 ELSE 0 END AS y FROM p)
 SELECT packet_id, line, """ + _grid("x", "y", 48, 128) + " AS pixel_id FROM xy")
def pixel_miracles(spark, d):
    return readouts(spark, d).where("amp_a + amp_b > 0").select("packet_id", "line", P.miracles(V.ring(c("fiber")), c("grp"), c("amp_a"), c("amp_b")).alias("pixel_id"))


_pixels("pixel_vmm_freia", ("63 - channel", "(suppkey % 32) * 32 + 47 - channel", 64, 1024), _on(lambda: P.pixel2d(P.strip(0, c("channel")), P.wire((c("suppkey") % 32) * 32, c("channel")), 64, 1024)))
_pixels("pixel_vmm_amor", ("63 - channel", "(suppkey % 14) * 32 + 47 - channel", 64, 448), _on(lambda: P.pixel2d(P.strip(0, c("channel")), P.wire((c("suppkey") % 14) * 32, c("channel")), 64, 448)))
_pixels("pixel_vmm_estia", ("(suppkey % 48) * 32 + channel - 16", "(suppkey // 48) * 64 + 63 - channel", 1536, 128), _on(lambda: P.pixel2d(P.estia_wire(P.estia_offsets(c("suppkey"))[0], c("channel")), P.strip(P.estia_offsets(c("suppkey"))[1], c("channel")), 1536, 128)))
_pixels("pixel_vmm_nmx", ("CASE WHEN line % 2 = 1 THEN (suppkey % 10) * 128 + (1 - vmm % 2) * 64 + 63 - channel ELSE (suppkey % 10) * 128 + (vmm % 2) * 64 + channel END", "(partkey % 10) * 128 + (vmm % 2) * 64 + channel", 1280, 1280),
        _on(lambda: P.pixel2d(P.nmx_coordinate(c("channel"), c("vmm") % 2, (c("suppkey") % 10) * 128, c("line") % 2 == 1), P.nmx_coordinate(c("channel"), c("vmm") % 2, (c("partkey") % 10) * 128, F.lit(False)), 1280, 1280)))

_WIRE = "CASE WHEN hyb = {hyb} AND CASE WHEN asic = 0 THEN {ch} BETWEEN 32 AND 63 ELSE {ch} BETWEEN 0 AND 63 END THEN CASE WHEN rot THEN (11 - ({n}) // 16) * 16 + ({n}) % 16 ELSE {n} END + 16 * (suppkey % 4) END"


def _trex_sql(channel: str, odd: str, hybrid: int = 0) -> str:
    n = f"(asic * 64 + {channel} - 32 + CASE WHEN {odd} THEN 96 ELSE 0 END)"
    wire = _WIRE.format(ch=channel, n=n, hyb=hybrid)
    return RO + f""", h AS (SELECT *, vmm // 14 AS hyb, vmm % 2 AS asic, suppkey % 2 = 1 AS rot, partkey % 64 AS g FROM readouts), w AS (SELECT packet_id, line, {wire} AS wire, (64 + g - 58) AS grid FROM h)
 SELECT packet_id, line, CASE WHEN wire // 16 BETWEEN 0 AND 383 AND grid BETWEEN 0 AND 139 THEN CAST(wire // 16 + grid * 384 + 1 + (wire % 16) * 384 * 140 AS BIGINT) END AS pixel_id FROM w"""


def _trex(channel, odd, **let):
    hybrid, asic = T.div(c("vmm"), 14), c("vmm") % 2
    grid = P.trex_grid(F.lit(1), F.lit(1), c("partkey") % 64, F.lit(False), F.lit(False), F.lit(0))
    return P.trex_pixel(P.trex_wire(F.when(odd, 1).otherwise(0), hybrid, asic, channel, c("suppkey") % 2 == 1, c("suppkey") % 4, **let), grid)


@query("pixel_vmm_trex", _trex_sql("channel", "fen % 2 = 1"))
def pixel_vmm_trex(spark, d):
    return readouts(spark, d).select("packet_id", "line", _trex(c("channel"), c("fen") % 2 == 1).alias("pixel_id"))


_SWAPPED = "(CASE WHEN channel % 2 = 0 THEN channel + 1 ELSE channel - 1 END)"


@query("pixel_vmm_let", _trex_sql(_SWAPPED, "(fiber // 2) % 2 = 0", P.LET_WIRES))
def pixel_vmm_let(spark, d):
    return readouts(spark, d).select("packet_id", "line", _trex(P.swap_odd_even(c("channel")), V.ring(c("fiber")) % 2 == 0, wires=P.LET_WIRES).alias("pixel_id"))


_CASSETTE = "(CASE sumo WHEN 6 THEN 2 * (cathode // 16) - anode // 32 WHEN 5 THEN anode // 32 + 2 * (cathode // 16) WHEN 4 THEN anode // 32 + 2 * (cathode // 16) - 1 WHEN 3 THEN anode // 32 + 2 * (cathode // 32) END & 255)"
_pixels("pixel_cdt_sumo", ("(fiber * 56 + CASE WHEN fiber > 22 THEN NULL WHEN sumo = 3 AND cas < 4 THEN 48 WHEN sumo = 4 AND cas < 6 THEN 36 WHEN sumo = 5 AND cas < 8 THEN 20 WHEN sumo = 6 AND cas < 10 THEN 0 END + 2 * cas + (anode // 16) % 2)", "(cathode % 16) * 16 + anode % 16", 1288, 256),
        _on(lambda: P.sumo(c("fiber"), c("line") % 4 + 3, c("anode"), c("cathode"), 1288, 256)), RO + f", s0 AS (SELECT *, line % 4 + 3 AS sumo FROM readouts), s AS (SELECT *, {_CASSETTE} AS cas FROM s0)", "s")
_MANTLE = "2 * (partkey % 6) + (anode // 32) % 2"
_pixels("pixel_cdt_mantle", ("cathode % 256", f"60 * (anode % 32) + 12 * (line % 5) + {_MANTLE}", 256, 1920), _on(lambda: P.mantle(c("line") % 5, c("partkey") % 6, c("anode"), c("cathode"))))
_pixels("pixel_cdt_heimdal", (f"12 * (suppkey % 12) + {_MANTLE}", "cathode % 64 + (anode % 32) * 64", 144, 2048), _on(lambda: P.heimdal(c("suppkey") % 12, c("partkey") % 6, c("anode"), c("cathode"))))
_X, _Y = "(2 * (anode // 32 + 2 * (cathode // 32)) + (anode // 16) % 2)", "(15 - anode % 16)"
_pixels("pixel_cdt_cuboid", (f"16 * (suppkey % 7) + CASE line % 4 WHEN 1 THEN 15 - {_Y} WHEN 2 THEN 15 - {_X} WHEN 3 THEN {_Y} ELSE {_X} END", f"112 * (cathode % 32) + 16 * (partkey % 7) + CASE line % 4 WHEN 1 THEN {_X} WHEN 2 THEN 15 - {_Y} WHEN 3 THEN 15 - {_X} ELSE {_Y} END", 112, 3584),
        _on(lambda: P.cuboid(c("anode"), c("cathode"), c("line") % 4, 16 * (c("suppkey") % 7), 16 * (c("partkey") % 7), 112, 3584)))


def _cuboids(kind: str) -> None:
    """Cuboids of a detector at their places; the unit chooses which of the module's two indices counts, and a third unit has none."""
    places = ", ".join(f"[{x}, {y}, {turn}]" for x, y, turn in P.CUBOIDS[kind])
    source = RO + f", r0 AS (SELECT *, list_extract([{places}], CASE line % 3 WHEN 0 THEN suppkey % 40 WHEN 1 THEN partkey % 40 END::BIGINT + 1) AS place, {_X} AS lx, {_Y} AS ly FROM readouts)"
    x = "place[1] + CASE place[3] WHEN 1 THEN 15 - ly WHEN 2 THEN 15 - lx WHEN 3 THEN ly ELSE lx END"
    y = "112 * (cathode % 32) + place[2] + CASE place[3] WHEN 1 THEN lx WHEN 2 THEN 15 - ly WHEN 3 THEN 15 - lx ELSE ly END"
    _pixels(f"pixel_cdt_cuboid_{kind}", (x, y, 112, 3584), _on(lambda: P.cuboid_at(kind, c("line") % 3, c("suppkey") % 40, c("partkey") % 40, c("anode"), c("cathode"))), source, "r0")


_cuboids("sans")
_cuboids("hr")
_pixels("pixel_cdt_pa", ("(fiber % 8) * 32 + 2 * (anode // 32 + 4 * (cathode // 64)) + (anode // 16) % 2", "(cathode % 32) * 16 + anode % 16", 256, 512), _on(lambda: P.pa(c("fiber") % 8, c("anode"), c("cathode"), 256, 512)))


@query("pixel_cbm", RO + " SELECT packet_id, line, CAST(CASE WHEN line % 3 + 1 = 2 THEN CASE WHEN anode < 100 AND cathode < 90 THEN anode + cathode * 100 + 1 + 1000 END WHEN line % 3 + 1 = 1 THEN 1000 ELSE 0 END AS BIGINT) AS pixel_id FROM readouts")
def pixel_cbm(spark, d):
    return readouts(spark, d).select("packet_id", "line", P.beam_monitor(c("line") % 3 + 1, c("anode"), c("cathode"), F.lit(100), F.lit(90), F.lit(1000)).alias("pixel_id"))


@query("pixel_timepix", RO + """ SELECT packet_id, line, (anode % 64) * 2 + (channel % 8) // 4 AS x, (cathode // 4) * 4 + ((channel % 8) & 3) AS y, CAST(trunc((suppkey * 409600.0::DOUBLE + partkey * 25.0::DOUBLE) - (vmm * 1.5625::DOUBLE)) AS BIGINT) AS clock,
 CAST(trunc(adc * 1e9::DOUBLE * 3.125::DOUBLE + vmm * 0.26::DOUBLE) AS BIGINT) // 26843545600 AS quarter, CAST(trunc(adc * 1e9::DOUBLE * 3.125::DOUBLE + vmm * 0.26::DOUBLE) AS BIGINT) % 26843545600 AS tdc_time FROM readouts""")
def pixel_timepix(spark, d):
    x, y = P.timepix_xy((c("anode") % 64) * 2, T.div(c("cathode"), 4) * 4, c("channel") % 8)
    tdc = P.tdc_clock(c("adc") * F.lit(1e9), c("vmm"))
    return readouts(spark, d).select("packet_id", "line", x.cast("long").alias("x"), y.cast("long").alias("y"), P.timepix_clock(c("suppkey"), c("partkey"), c("vmm")).alias("clock"), tdc["quarter"].alias("quarter"), tdc["time"].alias("tdc_time"))


@query("pixel_multigrid", RO + " SELECT packet_id, line, 11 - anode // 16 + 3 AS x, 15 - anode % 16 + 2 AS z FROM readouts")
def pixel_multigrid(spark, d):
    x, z = P.multigrid(c("anode"), 16, 3, 2, flip_x=12, flip_z=True)
    return readouts(spark, d).select("packet_id", "line", x.alias("x"), z.alias("z"))


# histograms --------------------------------------------------------------------------------------------------------------------
LOW, PERIOD, BINS = 2 * DAY, 302 * DAY, 48
STEP = (PERIOD - LOW) // BINS
OK = TOF + ", ok AS (SELECT *, CASE WHEN now >= 0 THEN now ELSE before END AS tof FROM t WHERE reject IS NULL)"
BIN = f"(tof - {LOW}) // {STEP}"


def _ok(spark, d):
    return _tof(spark, d).where("t.reject IS NULL").withColumn("tof", c("t.tof"))


@query("histogram_drop", OK + f" SELECT source, CAST({BIN} AS INT) AS bin, count(*) AS n, CAST(sum(weight) AS BIGINT) AS total FROM ok WHERE tof >= {LOW} AND {BIN} < {BINS} GROUP BY ALL")
def histogram_drop(spark, d):
    return H.histogram(_ok(spark, d), ["source"], "tof", LOW, PERIOD, BINS, "weight")


@query("histogram_lastbin", OK + f" SELECT source, CAST(least((tof - {LOW}) // {STEP // 2}, {BINS - 1}) AS INT) AS bin, count(*) AS n, CAST(sum(weight) AS BIGINT) AS total FROM ok WHERE tof >= {LOW} GROUP BY ALL")
def histogram_lastbin(spark, d):
    return H.histogram(_ok(spark, d), ["source"], "tof", LOW, LOW + BINS * (STEP // 2), BINS, "weight", last_bin=True)


FRAMES = OK + ", g AS (SELECT source, pulse, CAST((row_number() OVER (PARTITION BY source ORDER BY pulse) - 1) // 5 AS BIGINT) AS frame_group FROM (SELECT DISTINCT source, pulse FROM ok)), fr AS (SELECT ok.*, g.frame_group FROM ok JOIN g USING (source, pulse))"
FRAME_BINS = f" SELECT source, frame_group, CAST({BIN} AS INT) AS bin, count(*) AS n, {{signal}} AS signal FROM fr WHERE tof >= {LOW} AND {BIN} < {BINS} GROUP BY ALL"


@query("histogram_frames_sum", FRAMES + FRAME_BINS.format(signal="CAST(sum(weight) AS BIGINT)"))
def histogram_frames_sum(spark, d):
    return H.frame_histogram(_ok(spark, d), ["source"], "pulse", "tof", LOW, PERIOD, BINS, 5, "weight")


@query("histogram_frames_avg", FRAMES + FRAME_BINS.format(signal="CAST(sum(weight) AS BIGINT) // count(*)"))
def histogram_frames_avg(spark, d):
    return H.frame_histogram(_ok(spark, d), ["source"], "pulse", "tof", LOW, PERIOD, BINS, 5, "weight", mean=True)


@query("histogram_messages", FRAMES + f""", b AS (SELECT *, CASE WHEN tof >= {LOW} AND {BIN} < {BINS} THEN {BIN} END AS bin FROM fr), s AS (SELECT source, frame_group, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL),
 k AS (SELECT DISTINCT source, frame_group FROM s), dense AS (SELECT source, frame_group, list(coalesce(n, 0) ORDER BY i)::BIGINT[] AS signal FROM (SELECT k.*, i.i, s.n FROM k, range({BINS}) i(i) LEFT JOIN s ON s.source = k.source AND s.frame_group = k.frame_group AND s.bin = i.i) GROUP BY ALL),
 pt AS (SELECT source, frame_group, pulse, count(bin) AS total FROM b GROUP BY ALL), fs AS (SELECT source, frame_group, max(pulse) AS message_time, list(pulse ORDER BY pulse) AS pulses, list(total ORDER BY pulse) AS frame_total FROM pt GROUP BY ALL)
 SELECT source, frame_group, to_json(signal)::VARCHAR AS signal, message_time, to_json(list_transform(pulses, lambda p: p - pulses[1]))::VARCHAR AS reference_time, to_json(frame_total)::VARCHAR AS frame_total FROM dense JOIN fs USING (source, frame_group)""")
def histogram_messages(spark, d):
    m = H.frame_messages(_ok(spark, d), ["source"], "pulse", "tof", LOW, PERIOD, BINS, 5)
    return m.select("source", "frame_group", F.to_json("signal").alias("signal"), "message_time", F.to_json("reference_time").alias("reference_time"), F.to_json("frame_total").alias("frame_total"))


@query("adc_histograms", RO + " SELECT vmm, adc >> 4 AS bin, count(*) AS n FROM readouts WHERE adc <> 0 GROUP BY ALL")
def adc_histograms(spark, d):
    return H.shifted_counts(readouts(spark, d), ["vmm"], "adc", 4, skip_zero=True)


@query("dynamic_histogram", "WITH " + HITS + " SELECT coordinate >> 0 AS bin, count(*) AS n FROM hits GROUP BY ALL")
def dynamic_histogram(spark, d):
    return H.shifted_counts(hits(spark, d), [], "coordinate", 0)


# order, sampling, batching, metrics ----------------------------------------------------------------------------------------------
@query("sequence_errors", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders), s AS (SELECT o_custkey % 50 AS queue, o_orderkey, o_orderkey // 50 AS seq FROM r), w AS (SELECT *, seq <> coalesce(lag(seq) OVER (PARTITION BY queue ORDER BY o_orderkey) + 1, 0) AS bad FROM s) SELECT queue, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS n FROM w GROUP BY ALL")
def sequence_errors(spark, d):
    rows = table(spark, d, "orders").select((c("o_custkey") % 50).alias("queue"), "o_orderkey", T.div(c("o_orderkey"), 50).alias("seq"))
    return S.sequence_errors(rows, ["queue"], "seq", ["o_orderkey"], 100_000).groupBy("queue").agg(F.sum(c("sequence_error").cast("long")).alias("errors"), F.count("*").alias("n"))


@query("raw_sample", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) SELECT event_id FROM r WHERE rn % 100 < 2")
def raw_sample(spark, d):
    return S.sample(table(spark, d, "events").select("event_id"), "event_id", 100, 2, 5000)


@query("chrono_merge", "WITH " + HITS + ", l AS (SELECT min(m) AS h FROM (SELECT module, max(time) AS m FROM hits GROUP BY module)) SELECT seq, module, time FROM hits, l WHERE time < h - 60000000")
def chrono_merge(spark, d):
    return S.chrono_merge(hits(spark, d), "module", "time", 60_000_000).select("seq", "module", "time")


@query("ev44_batches", OK + """, r AS (SELECT *, row_number() OVER (PARTITION BY source, pulse ORDER BY tof, l_orderkey, l_linenumber, suppkey, weight) AS rn FROM ok), b AS (SELECT source, pulse, (rn - 1) // 4 AS chunk, to_json(list(tof ORDER BY rn))::VARCHAR AS tof, to_json(list(suppkey ORDER BY rn))::VARCHAR AS pixel_id FROM r GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY pulse, chunk) AS message_id FROM b""")
def ev44_batches(spark, d):
    rows = _ok(spark, d).withColumn("pixel_id", c("suppkey"))
    out = S.with_message_ids(S.event_batches(rows, "source", "pulse", ["tof", "l_orderkey", "l_linenumber", "suppkey", "weight"], 4, ["tof", "pixel_id"]), "source", "pulse", 30 * DAY)
    return out.withColumns({"tof": F.to_json("tof"), "pixel_id": F.to_json("pixel_id")})


_READINGS = "SELECT event_type AS name, epoch_us(date_trunc('day', ts)) // 1000000 AS t, CAST(sum(floor(value)) AS BIGINT) AS v FROM events GROUP BY ALL"


def _readings(spark, d):
    from pulsegrid.plans.fixtures import micros

    day = T.div(micros("ts"), DAY) * (DAY // 1_000_000)
    return table(spark, d, "events").groupBy(c("event_type").alias("name"), day.alias("t")).agg(F.sum(F.floor("value").cast("long")).alias("v"))


@query("rates", f"WITH r AS ({_READINGS}), w AS (SELECT *, v - lag(v) OVER k AS dv, t - lag(t) OVER k AS dt FROM r WINDOW k AS (PARTITION BY name ORDER BY t)) SELECT name, t, v, dv::DOUBLE / dt AS rate FROM w")
def rates(spark, d):
    return S.rates(_readings(spark, d), "name", "t", "v")


@query("runtime_mask", f"WITH r AS (SELECT t, CAST(ascii(name) % 16 AS INT) AS i, v % 7 AS v FROM ({_READINGS})), w AS (SELECT t, CASE WHEN v <> coalesce(lag(v) OVER (PARTITION BY i ORDER BY t, v), 0) THEN 1 << i ELSE 0 END AS bit FROM r) SELECT t, CAST(bit_or(bit) AS INT) AS mask FROM w GROUP BY t")
def runtime_mask(spark, d):
    rows = _readings(spark, d).select("t", (F.ascii("name") % 16).alias("i"), (c("v") % 7).alias("v"))
    return S.runtime_mask(rows, "t", "i", "v")


@query("as_of_pulse", "WITH " + HITS + ", p AS (SELECT epoch_us(o_orderdate) + 900000000000000 // 1 - 60 * 86400000000 AS pt, o_orderkey FROM orders) SELECT seq, time, pt, o_orderkey FROM hits ASOF LEFT JOIN (SELECT pt, max(o_orderkey) AS o_orderkey FROM p GROUP BY pt) q ON hits.time >= q.pt")
def as_of_pulse(spark, d):
    from pulsegrid.plans.fixtures import micros

    pulses = table(spark, d, "orders").select((micros("o_orderdate") + 900000000000000 - 60 * DAY).alias("pt"), "o_orderkey").groupBy("pt").agg(F.max("o_orderkey").alias("o_orderkey"))
    return S.as_of(hits(spark, d), pulses, "time", "pt", ["o_orderkey"], 10 * DAY).select("seq", "time", "pt", "o_orderkey")


@query("counter_gap_fold", "WITH RECURSIVE " + HITS + """, o AS (SELECT module, time // 3600000000 AS hour, seq % 11 AS c, row_number() OVER (PARTITION BY module, time // 3600000000 ORDER BY time, seq) AS i FROM hits),
 r AS (SELECT module, hour, i, c AS last, 1 AS ok, 0 AS dropped, 0::BIGINT AS missed FROM o WHERE i = 1 UNION ALL
 SELECT o.module, o.hour, o.i, CASE WHEN (o.c = r.last OR (o.c < r.last AND o.c NOT IN (0, 1))) THEN r.last ELSE o.c END, CASE WHEN (o.c = r.last OR (o.c < r.last AND o.c NOT IN (0, 1))) THEN r.ok ELSE r.ok + 1 END,
 CASE WHEN (o.c = r.last OR (o.c < r.last AND o.c NOT IN (0, 1))) THEN r.dropped + 1 ELSE r.dropped END, CASE WHEN o.c > r.last + 1 THEN r.missed + o.c - r.last - 1 ELSE r.missed END
 FROM r JOIN o ON o.module = r.module AND o.hour = r.hour AND o.i = r.i + 1)
 SELECT module, hour, arg_max(ok, i)::BIGINT AS accepted, arg_max(dropped, i)::BIGINT AS dropped, arg_max(missed, i)::BIGINT AS missed FROM r GROUP BY ALL""")
def counter_gap_fold(spark, d):
    rows = hits(spark, d).withColumns({"hour": T.div(c("time"), 3_600_000_000), "counter": c("seq") % 11})
    return S.counter_gaps(rows, ["module", "hour"], "counter", ["time", "seq"])


# decoding ------------------------------------------------------------------------------------------------------------------------
def _caen_packets(spark, d):
    r = readouts(spark, d)
    order = ["line", "partkey", "suppkey", "amp_a", "amp_b"]
    rec = encode.record("caen", {"fiber": c("fiber"), "fen": c("fen"), "time_high": c("suppkey"), "time_low": c("partkey"), "grp": c("grp"), "amp_a": c("amp_a"), "amp_b": -c("amp_b"), "amp_c": c("amp_c"), "amp_d": c("amp_d")})
    return encode.payloads(r, ["packet_id"], order, rec)


POSITIONED = RO + ", n AS (SELECT *, CAST(row_number() OVER (PARTITION BY packet_id ORDER BY line, partkey, suppkey, amp_a, amp_b) - 1 AS INT) AS pos FROM readouts)"


@query("decode_caen", POSITIONED + ", b AS (SELECT *, CASE WHEN fiber > 23 THEN 'fiber' WHEN fen > 23 THEN 'fen' END AS bad FROM n), f AS (SELECT *, min(CASE WHEN bad IS NOT NULL THEN pos END) OVER (PARTITION BY packet_id) AS first_bad FROM b) SELECT packet_id, pos, fiber::BIGINT AS fiber, fen::BIGINT AS fen, suppkey AS time_high, partkey AS time_low, grp::BIGINT AS grp, amp_a::BIGINT AS amp_a, -amp_b::BIGINT AS amp_b, amp_c::BIGINT AS amp_c, CASE WHEN pos > first_bad THEN 'after_bad' ELSE bad END AS reject_reason FROM f")
def decode_caen(spark, d):
    rows = decode.readouts(_caen_packets(spark, d), "caen", ["packet_id"])
    return rows.select("packet_id", "pos", "fiber", "fen", "time_high", "time_low", "grp", "amp_a", "amp_b", "amp_c", "reject_reason")


@query("decode_vmm3", POSITIONED + " SELECT packet_id, pos, fiber::BIGINT AS fiber, fen::BIGINT AS fen, adc::BIGINT AS otadc, vmm::BIGINT AS vmm, channel::BIGINT AS channel, CASE WHEN fiber > 23 THEN 'fiber' WHEN fen > 23 THEN 'fen' WHEN adc > 1023 THEN 'adc' END AS reject_reason FROM n")
def decode_vmm3(spark, d):
    rec = encode.record("vmm3", {"fiber": c("fiber"), "fen": c("fen"), "time_high": c("suppkey"), "time_low": c("partkey"), "otadc": c("adc"), "vmm": c("vmm"), "channel": c("channel")})
    packets = encode.payloads(readouts(spark, d), ["packet_id"], ["line", "partkey", "suppkey", "amp_a", "amp_b"], rec)
    return decode.readouts(packets, "vmm3", ["packet_id"]).select("packet_id", "pos", "fiber", "fen", "otadc", "vmm", "channel", "reject_reason")


@query("decode_cdt", POSITIONED + ", b AS (SELECT *, CASE WHEN fiber > 23 THEN 'fiber' WHEN fen > 12 THEN 'fen' END AS bad FROM n), f AS (SELECT *, min(CASE WHEN bad IS NOT NULL THEN pos END) OVER (PARTITION BY packet_id) AS first_bad FROM b) SELECT packet_id, pos, anode::BIGINT AS anode, cathode::BIGINT AS cathode, CASE WHEN pos > first_bad THEN 'after_bad' ELSE bad END AS reject_reason FROM f")
def decode_cdt(spark, d):
    rec = encode.record("cdt", {"fiber": c("fiber"), "fen": c("fen"), "anode": c("anode"), "cathode": c("cathode")})
    packets = encode.payloads(readouts(spark, d), ["packet_id"], ["line", "partkey", "suppkey", "amp_a", "amp_b"], rec)
    return decode.readouts(packets, "cdt", ["packet_id"]).select("packet_id", "pos", "anode", "cathode", "reject_reason")


@query("decode_cbm", POSITIONED + ", b AS (SELECT *, CASE WHEN fiber > 23 THEN 'fiber' WHEN fen > 23 THEN 'fen' WHEN line % 5 NOT BETWEEN 1 AND 3 THEN 'kind' END AS bad FROM n), f AS (SELECT *, min(CASE WHEN bad IS NOT NULL THEN pos END) OVER (PARTITION BY packet_id) AS first_bad FROM b) SELECT packet_id, pos, (line % 5)::BIGINT AS kind, CASE WHEN line % 5 = 2 THEN anode::BIGINT END AS x, CASE WHEN line % 5 = 3 THEN (anode + 65536 * (cathode % 256))::BIGINT END AS value24, CASE WHEN pos > first_bad THEN 'after_bad' ELSE bad END AS reject_reason FROM f")
def decode_cbm(spark, d):
    rec = encode.record("cbm", {"fiber": c("fiber"), "fen": c("fen"), "kind": c("line") % 5, "x": c("anode"), "y": c("cathode")})
    packets = encode.payloads(readouts(spark, d), ["packet_id"], ["line", "partkey", "suppkey", "amp_a", "amp_b"], rec)
    return decode.beam_values(decode.readouts(packets, "cbm", ["packet_id"])).select("packet_id", "pos", "kind", "x", "value24", "reject_reason")


@query("packet_headers", "WITH p AS (SELECT o_orderkey AS packet_id, o_orderkey % 14 AS queue, o_custkey % 3 AS version, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS pad FROM orders) SELECT CASE WHEN pad <> 0 THEN 'pad' WHEN version > 1 THEN 'version' WHEN version = 1 THEN 'header' WHEN queue >= 12 THEN 'queue' ELSE 'ok' END AS reason, count(*) AS n FROM p GROUP BY ALL")
def packet_headers(spark, d):
    o = table(spark, d, "orders").withColumn("data", F.expr("X''"))
    packets = encode.with_packet_header(o, {"pad": F.when(c("o_orderkey") % 17 == 0, 1).otherwise(0), "version": c("o_custkey") % 3, "type": F.lit(0x34), "queue": c("o_orderkey") % 14, "pulse_high": F.lit(1000), "prev_high": F.lit(1000)})
    return V.counters(decode.with_header(packets, 0x34))
