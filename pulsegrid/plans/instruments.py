"""Queries: whole instruments, from encoded packets to pixel events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import pixels as P
from pulsegrid.plans.catalog import query
from pulsegrid.plans.clustering import SIDES, STATS, _islands
from pulsegrid.plans.fixtures import READOUTS, readouts, table
from pulsegrid.plans.readout import _CASSETTE, _X, _Y
from pulsegrid.sources import encode
from pulsegrid.streaming.instruments import cdt_event_rows, instrument_events
from pulsegrid.streaming.pipeline import Settings, type_number

c = F.col
ORDER = ["line", "partkey", "suppkey", "amp_a", "amp_b"]
SECOND = 1000
POS = f"CAST(row_number() OVER (PARTITION BY packet_id ORDER BY {', '.join(ORDER)}) - 1 AS INT) AS pos"
LOW = "1000 + partkey % 20 * 10"
TIME = f"{SECOND}000000000 + CAST(trunc(({LOW}) * (1e9::DOUBLE / 88052500)) AS BIGINT)"


def _packets(spark, d, detector: str, kind: str, fields: dict):
    rec = encode.record(kind, {"time_high": F.lit(SECOND), "time_low": 1000 + c("partkey") % 20 * 10, **fields})
    payloads = encode.payloads(readouts(spark, d), ["packet_id"], ORDER, rec)
    return encode.with_packet_header(payloads, {"type": F.lit(type_number(detector)), "pulse_high": F.lit(SECOND), "prev_high": F.lit(SECOND)}).select("packet_id", "payload")


def _config(spark, d):
    """Rings 0 to 10 of twelve FENs from parts, some of them without an entry."""
    rows = table(spark, d, "part").where("p_partkey < 132 AND p_partkey % 7 <> 3")
    key = c("p_partkey").cast("int")
    return rows.withColumns({"key": key, "ring": F.floor(key / 12).cast("int"), "fen": key % 12})


CONFIG = "config AS (SELECT *, CAST(p_partkey AS INT) AS key, CAST(p_partkey // 12 AS INT) AS ring, CAST(p_partkey % 12 AS INT) AS cfen FROM part WHERE p_partkey < 132 AND p_partkey % 7 <> 3)"


@query("instrument_freia", f"""WITH {READOUTS}, {CONFIG}, n AS (SELECT *, {POS} FROM readouts),
 hits AS (SELECT packet_id, key AS module, 1 - line % 2 AS plane, pos AS seq, {TIME} AS time, CASE WHEN line % 2 = 1 THEN 63 - (16 + partkey % 32) ELSE (key % 32) * 32 + 47 - (16 + partkey % 32) END AS coordinate, adc AS weight
 FROM n JOIN config ON ring = packet_id % 22 // 2 AND cfen = packet_id % 12 WHERE adc BETWEEN 100 AND 1023),
 {_islands('hits', 'packet_id, module, plane', 'time', 500, 'tc')}, {_islands('tc', 'packet_id, module, plane, tc_id', 'coordinate', 0, 'cc', order='time, seq')},
 clusters AS ({STATS.format(keys='packet_id, module, plane, tc_id, cc_id', source='cc')}), {_islands('clusters', 'packet_id, module', 'time_start', 500, 'ev', end='time_end', order='plane, time_end')},
 evs AS (SELECT packet_id, module, ev_id, min(time_start) AS time_start, {SIDES} FROM ev GROUP BY ALL),
 p AS (SELECT *, CAST(round(a_wc::DOUBLE / a_w) AS BIGINT) AS x, CAST(round(b_wc::DOUBLE / b_w) AS BIGINT) AS y FROM evs WHERE a_n >= a_coord_end - a_coord_start + 1 AND b_n >= b_coord_end - b_coord_start + 1)
 SELECT packet_id, {SECOND}000000000 AS reference_time, time_start - {SECOND}000000000 AS tof, x + y * 64 + 1 AS pixel_id FROM p WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 1023""")
def instrument_freia(spark, d):
    packets = _packets(spark, d, "freia", "vmm3", {"fiber": c("packet_id") % 22, "fen": c("packet_id") % 12, "otadc": c("adc"), "vmm": c("line") % 2, "channel": 16 + c("partkey") % 32})
    hybrids = _config(spark, d).select("ring", "fen", F.lit(0).alias("hybrid"), c("key").alias("number"), F.lit(0).alias("x_offset"), (c("key") % 32 * 32).alias("y_offset"), F.lit(100).alias("threshold0"), F.lit(100).alias("threshold1"))
    return instrument_events(packets, Settings("freia"), {"hybrids": hybrids})


_KINDS = ("FwEndCap", "BwEndCap", "DreamMantle", "SANS", "HR")


def _places(kind: str) -> str:
    return "[" + ", ".join(f"[{x}, {y}, {turn}]" for x, y, turn in P.CUBOIDS[kind]) + "]"


_TURN_X = "CASE place[3] WHEN 1 THEN 15 - ly WHEN 2 THEN 15 - lx WHEN 3 THEN ly ELSE lx END"
_TURN_Y = "CASE place[3] WHEN 1 THEN lx WHEN 2 THEN 15 - ly WHEN 3 THEN 15 - lx ELSE ly END"
_SUMO = "CASE WHEN unit = 3 AND cas < 4 THEN 48 WHEN unit = 4 AND cas < 6 THEN 36 WHEN unit = 5 AND cas < 8 THEN 20 WHEN unit = 6 AND cas < 10 THEN 0 END"


@query("instrument_dream", f"""WITH {READOUTS}, {CONFIG}, n AS (SELECT *, {POS} FROM readouts), b AS (SELECT *, min(CASE WHEN fiber > 23 OR fen > 12 THEN pos END) OVER (PARTITION BY packet_id) AS first_bad FROM n),
 r AS (SELECT b.*, line % 8 AS unit, line % 8 AS sumo, key % 5 AS kind, p_size % 5 AS one, p_size % 6 AS two, {_X} AS lx, {_Y} AS ly FROM b LEFT JOIN config ON ring = fiber // 2 AND cfen = fen WHERE first_bad IS NULL OR pos < first_bad),
 s AS (SELECT *, {_CASSETTE} AS cas, list_extract(CASE kind WHEN 3 THEN {_places('sans')} WHEN 4 THEN {_places('hr')} END, CASE unit WHEN 0 THEN one WHEN 1 THEN two END::BIGINT + 1) AS place FROM r),
 xy AS (SELECT *, CASE WHEN kind < 2 THEN one * 56 + {_SUMO} + 2 * cas + (anode // 16) % 2 WHEN kind = 2 THEN cathode % 256 ELSE place[1] + {_TURN_X} END AS x,
 CASE WHEN kind < 2 THEN (cathode % 16) * 16 + anode % 16 WHEN kind = 2 THEN 60 * (anode % 32) + 12 * one + 2 * two + (anode // 32) % 2 ELSE 112 * (cathode % 32) + place[2] + {_TURN_Y} END AS y,
 CASE kind WHEN 0 THEN 280 WHEN 1 THEN 616 WHEN 2 THEN 256 ELSE 112 END AS nx, CASE kind WHEN 0 THEN 256 WHEN 1 THEN 256 WHEN 2 THEN 1920 ELSE 3584 END AS ny, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 71680 WHEN 2 THEN 229376 WHEN 3 THEN 720896 ELSE 1122304 END AS first_id FROM s),
 e AS (SELECT *, CASE WHEN x >= 0 AND x < nx AND y >= 0 AND y < ny THEN CAST(first_id + x + y * nx + 1 AS BIGINT) END AS pixel_id FROM xy)
 SELECT packet_id, pos, {TIME} - {SECOND}000000000 AS tof, pixel_id, CASE WHEN fen > 11 THEN 'fen' WHEN kind IS NULL THEN 'mapping' WHEN pixel_id IS NULL THEN 'pixel' END AS reject_reason FROM e""")
def instrument_dream(spark, d):
    packets = _packets(spark, d, "dream", "cdt", {"fiber": c("fiber"), "fen": c("fen"), "unit": c("line") % 8, "anode": c("anode"), "cathode": c("cathode")})
    kind = F.get(F.array(*map(F.lit, _KINDS)), c("key") % 5)
    modules = _config(spark, d).select("ring", "fen", kind.alias("kind"), (c("p_size") % 5).alias("first"), (c("p_size") % 6).alias("second"))
    return cdt_event_rows(packets, Settings("dream"), modules).select("packet_id", "pos", "tof", "pixel_id", "reject_reason")
