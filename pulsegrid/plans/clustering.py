"""Queries: clustering, matching, filters and reducers over hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.pixels import vmm_pixel
from pulsegrid.operators import cluster as C
from pulsegrid.operators import match as M
from pulsegrid.operators import stream_order as S
from pulsegrid.plans.catalog import query
from pulsegrid.plans.fixtures import DAY, HITS, MINUTE, hits

KEYS = ["module", "plane"]
T_GAP, C_GAP = 5 * MINUTE, 3


def _islands(source: str, keys: str, start: str, gap: int, out: str, end: str | None = None, order: str = "seq") -> str:
    end = end or start
    return f"""{out}_f AS (SELECT *, max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{out} AS (SELECT * EXCLUDE (reach), max(CASE WHEN reach IS NULL OR {start} - reach > {gap} THEN {start} END) OVER (PARTITION BY {keys} ORDER BY {start}, {order} ROWS UNBOUNDED PRECEDING) AS {out}_id FROM {out}_f)"""


TIMED = "WITH " + HITS + ", " + _islands("hits", "module, plane", "time", T_GAP, "tc")
COORD = TIMED + ", " + _islands("tc", "module, plane, tc_id", "coordinate", C_GAP, "cc", order="time, seq")
STATS = """SELECT {keys}, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w, CAST(sum(weight::BIGINT*weight) AS BIGINT) AS w2, min(time) AS time_start, max(time) AS time_end,
 CAST(sum(weight::BIGINT*coordinate) AS BIGINT) AS wc, CAST(sum(weight::BIGINT*weight*coordinate) AS BIGINT) AS w2c, min(coordinate) AS coord_start, max(coordinate) AS coord_end,
 arg_min(coordinate, (time, seq)) AS coord_earliest, arg_max(coordinate, (time, -seq)) AS coord_latest FROM {source} GROUP BY {keys}"""
CLUSTERS = TIMED + ", clusters AS (" + STATS.format(keys="module, plane, tc_id", source="tc") + ")"


def timed(spark, d):
    return C.time_clusters(hits(spark, d), KEYS, T_GAP, width=DAY)


def clusters(spark, d):
    return C.cluster_stats(timed(spark, d), [*KEYS, "time_cluster"])


@query("time_clusters", TIMED + " SELECT module, plane, tc_id AS time_cluster, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w FROM tc GROUP BY ALL")
def time_clusters(spark, d):
    return timed(spark, d).groupBy(*KEYS, "time_cluster").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))


@query("coord_clusters", COORD + " SELECT module, plane, tc_id AS time_cluster, cc_id AS coord_cluster, count(*) AS n, max(coordinate) AS coord_end FROM cc GROUP BY ALL")
def coord_clusters(spark, d):
    rows = C.coord_clusters(hits(spark, d), KEYS, T_GAP, C_GAP, width=DAY)
    return rows.groupBy(*KEYS, "time_cluster", "coord_cluster").agg(F.count("*").alias("n"), F.max("coordinate").alias("coord_end"))


@query("xz_clusters", TIMED + ", xz AS (SELECT *, coordinate // 16 AS x, coordinate % 16 AS z FROM tc), " + _islands("xz", "module, plane, tc_id", "x", 1, "xc", order="time, seq") + ", " + _islands("xc", "module, plane, tc_id, xc_id", "z", 2, "zc", order="time, seq") + " SELECT module, plane, tc_id AS time_cluster, CAST(xc_id AS BIGINT) AS x_cluster, CAST(zc_id AS BIGINT) AS z_cluster, count(*) AS n FROM zc GROUP BY ALL")
def xz_clusters(spark, d):
    rows = C.xz_clusters(hits(spark, d), KEYS, T_GAP, 1, 2, 16, width=DAY)
    return rows.groupBy(*KEYS, "time_cluster", "x_cluster", "z_cluster").agg(F.count("*").alias("n"))


@query("cluster_stats", CLUSTERS + " SELECT * EXCLUDE (tc_id), tc_id AS time_cluster, CASE WHEN w <> 0 THEN wc::DOUBLE / w END AS center, CASE WHEN w2 <> 0 THEN w2c::DOUBLE / w2 END AS center2, time_end - time_start + 1 AS time_span, coord_end - coord_start + 1 AS coord_span FROM clusters")
def cluster_stats(spark, d):
    return C.with_centres(clusters(spark, d))


@query("cluster_merge", COORD + ", parts AS (" + STATS.format(keys="module, plane, tc_id, cc_id", source="cc") + """) SELECT module, plane, tc_id AS time_cluster, CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS w, CAST(sum(w2) AS BIGINT) AS w2, CAST(sum(wc) AS BIGINT) AS wc, CAST(sum(w2c) AS BIGINT) AS w2c,
 min(time_start) AS time_start, max(time_end) AS time_end, min(coord_start) AS coord_start, max(coord_end) AS coord_end, arg_min(coord_earliest, (time_start, coord_start)) AS coord_earliest, arg_min(coord_latest, (time_start, coord_start)) AS coord_latest FROM parts GROUP BY ALL""")
def cluster_merge(spark, d):
    rows = C.coord_clusters(hits(spark, d), KEYS, T_GAP, C_GAP, width=DAY)
    return C.merge_stats(C.cluster_stats(rows, [*KEYS, "time_cluster", "coord_cluster"]), [*KEYS, "time_cluster"])


@query("cluster_stats_2d", TIMED + " SELECT module, plane, tc_id AS time_cluster, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w, CAST(sum(weight::BIGINT*(coordinate//8)) AS BIGINT) AS wc_x, CAST(sum(weight::BIGINT*(coordinate%8)) AS BIGINT) AS wc_y, max(coordinate//8) - min(coordinate//8) + 1 AS span_x, max(coordinate%8) - min(coordinate%8) + 1 AS span_y FROM tc GROUP BY ALL")
def cluster_stats_2d(spark, d):
    rows = timed(spark, d).withColumns({"x": F.floor(F.col("coordinate") / 8).cast("int"), "y": F.col("coordinate") % 8})
    s = C.cluster_stats(rows, [*KEYS, "time_cluster"], ("x", "y"))
    return s.select(*KEYS, "time_cluster", "n", "w", "wc_x", "wc_y", (F.col("coord_end_x") - F.col("coord_start_x") + 1).alias("span_x"), (F.col("coord_end_y") - F.col("coord_start_y") + 1).alias("span_y"))


def _event_sql(gap: int, start: str = "time_start", end: str = "time_end", order: str = "plane, time_end") -> str:
    return CLUSTERS + ", " + _islands("clusters", "module", start, gap, "ev", end=end, order=order)


SIDES = ", ".join(
    f"CAST(sum(CASE WHEN plane={p} THEN {c} END) AS BIGINT) AS {s}_{c}" for s, p in (("a", 0), ("b", 1)) for c in ("n", "w", "w2", "wc", "w2c")
) + ", " + ", ".join(f"{f}(CASE WHEN plane={p} THEN {c} END) AS {s}_{c}" for s, p in (("a", 0), ("b", 1)) for f, c in (("min", "time_start"), ("max", "time_end"), ("min", "coord_start"), ("max", "coord_end")))
EVENTS = _event_sql(MINUTE) + f", evs AS (SELECT module, ev_id AS event, min(time_start) AS time_start, max(time_end) AS time_end, {SIDES} FROM ev GROUP BY module, ev_id)"
MATCHED = " SELECT module, ev_id AS event, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS n, max(time_end) AS time_end FROM ev GROUP BY ALL"


def _summary(df):
    return df.groupBy("module", "event").agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), F.max("time_end").alias("time_end"))


@query("gap_match", _event_sql(MINUTE) + MATCHED)
def gap_match(spark, d):
    return _summary(M.gap_match(clusters(spark, d), ["module"], MINUTE, width=DAY))


@query("overlap_match", _event_sql(0) + MATCHED)
def overlap_match(spark, d):
    return _summary(M.overlap_match(clusters(spark, d), ["module"], width=DAY))


@query("end_match", _event_sql(2 * MINUTE, "time_end", "time_end", "plane, time_start") + MATCHED)
def end_match(spark, d):
    return _summary(M.end_match(clusters(spark, d), ["module"], 2 * MINUTE, width=DAY))


def event_rows(spark, d):
    return M.events(M.gap_match(clusters(spark, d), ["module"], MINUTE, width=DAY), ["module"])


@query("event_union", EVENTS + " SELECT * FROM evs")
def event_union(spark, d):
    return event_rows(spark, d)


@query("event_pixels", EVENTS + """, p AS (SELECT *, CAST(round(a_wc::DOUBLE / a_w) AS BIGINT) AS x, CAST(round(b_wc::DOUBLE / b_w) AS BIGINT) AS y FROM evs WHERE a_n > 0 AND b_n > 0 AND a_w > 0 AND b_w > 0)
 SELECT module, event, time_start, time_end, x + y * 64 + 1 AS pixel_id FROM p WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 1023""")
def event_pixels(spark, d):
    rows = M.both_planes(event_rows(spark, d)).withColumn("pixel_id", vmm_pixel(M.center("a"), M.center("b"), 64, 1024))
    return rows.where("pixel_id IS NOT NULL").select("module", "event", "time_start", "time_end", "pixel_id")


@query("event_filter_span", EVENTS + f""" SELECT module, event, CASE WHEN a_n IS NULL OR b_n IS NULL THEN 'single_plane' WHEN a_coord_end - a_coord_start + 1 < 2 OR b_coord_end - b_coord_start + 1 < 2 THEN 'span_min'
 WHEN a_coord_end - a_coord_start + 1 > 50 OR b_coord_end - b_coord_start + 1 > 50 THEN 'span_max' WHEN time_end - time_start + 1 > {20 * MINUTE} THEN 'time_span' END AS reject_reason FROM evs""")
def event_filter_span(spark, d):
    return M.span_filter(event_rows(spark, d), 2, 50, 20 * MINUTE).select("module", "event", "reject_reason")


@query("event_filter_gap", TIMED + " SELECT module, plane, tc_id AS time_cluster, count(*) + 1 < max(coordinate) - min(coordinate) + 1 AS has_gap FROM tc GROUP BY ALL")
def event_filter_gap(spark, d):
    s = timed(spark, d).groupBy(*KEYS, "time_cluster").agg(F.count("*").alias("k"), (F.max("coordinate") - F.min("coordinate") + 1).alias("span"))
    return s.select(*KEYS, "time_cluster", C.has_gap(F.col("k"), F.col("span"), 1).alias("has_gap"))


@query("reduce_com", EVENTS + " SELECT module, event, a_wc::DOUBLE / nullif(a_w, 0) AS x, b_wc::DOUBLE / nullif(b_w, 0) AS y, coalesce(a_w > 0 AND b_w > 0, FALSE) AS good, least(a_time_end, b_time_end) AS time FROM evs")
def reduce_com(spark, d):
    good = F.coalesce((F.col("a_w") > 0) & (F.col("b_w") > 0), F.lit(False))
    return event_rows(spark, d).select("module", "event", M.center("a").alias("x"), M.center("b").alias("y"), good.alias("good"), F.least("a_time_end", "b_time_end").alias("time"))


@query("reduce_charge2", EVENTS + " SELECT module, event, a_w2c::DOUBLE / nullif(a_w2, 0) AS x, b_w2c::DOUBLE / nullif(b_w2, 0) AS y FROM evs")
def reduce_charge2(spark, d):
    return event_rows(spark, d).select("module", "event", M.center("a", True).alias("x"), M.center("b", True).alias("y"))


def _utpc_sql(weighted: bool) -> str:
    value = "w2c::DOUBLE / nullif(w2, 0)" if weighted else "coordinate::DOUBLE"
    return TIMED + f""", r AS (SELECT *, row_number() OVER k - 1 AS i, count(*) OVER (PARTITION BY module, plane, tc_id) AS n, max(time) OVER (PARTITION BY module, plane, tc_id) AS top,
 sum(weight::BIGINT*weight) OVER b AS w2, sum(weight::BIGINT*weight*coordinate) OVER b AS w2c FROM tc WINDOW k AS (PARTITION BY module, plane, tc_id ORDER BY seq), b AS (PARTITION BY module, plane, tc_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 e AS (SELECT module, plane, tc_id, any_value(n) AS n, min(i) AS fi, max(i) AS li, arg_min(weight, i) AS fw, arg_max(weight, i) AS lw, arg_min({value}, i) AS fv, arg_max({value}, i) AS lv FROM r WHERE time = top GROUP BY ALL)
 SELECT module, plane, tc_id AS time_cluster, CASE WHEN fi < n - 1 - li OR (fi = n - 1 - li AND fw > lw) THEN fv ELSE lv END AS utpc FROM e"""


@query("reduce_utpc", _utpc_sql(False))
def reduce_utpc(spark, d):
    return M.utpc(timed(spark, d), [*KEYS, "time_cluster"])


@query("reduce_utpc_weighted", _utpc_sql(True))
def reduce_utpc_weighted(spark, d):
    return M.utpc(timed(spark, d), [*KEYS, "time_cluster"], weighted=True)


@query("reduce_maxweight", TIMED + ", m AS (SELECT *, max(weight) OVER (PARTITION BY module, plane, tc_id) AS top FROM tc) SELECT module, plane, tc_id AS time_cluster, sum(coordinate)::DOUBLE / count(*) AS center, count(*) AS hits_used FROM m WHERE weight = top GROUP BY ALL")
def reduce_maxweight(spark, d):
    return M.max_weight_center(timed(spark, d), [*KEYS, "time_cluster"])


@query("utpc_uncert", TIMED + """, m AS (SELECT *, max(time) OVER (PARTITION BY module, plane, tc_id) AS last, dense_rank() OVER (PARTITION BY module, plane, tc_id ORDER BY time DESC) AS bin FROM tc)
 SELECT module, plane, tc_id AS time_cluster, max(time) AS time, sum(coordinate) FILTER (time = last)::DOUBLE / count(*) FILTER (time = last) AS center,
 max(coordinate) FILTER (time = last) - min(coordinate) FILTER (time = last) + 1 AS uncert_lower, max(coordinate) FILTER (bin <= 3) - min(coordinate) FILTER (bin <= 3) + 1 AS uncert_upper,
 count(*) FILTER (time = last) AS hits_used FROM m GROUP BY ALL""")
def utpc_uncert(spark, d):
    return M.utpc_uncertainty(timed(spark, d), [*KEYS, "time_cluster"], 3)


def _part(plane: int, k: int) -> str:
    return f"CASE WHEN coalesce(max(part) FILTER (plane={plane}), 3) > 2 THEN 0 ELSE coalesce(sum(weight) FILTER (plane={plane} AND part={k}), 0) END::DOUBLE AS {'ab'[plane]}{k}"


@query("match_split", EVENTS.replace(", evs AS", ", evs0 AS") + f""", h AS (SELECT tc.*, ev.ev_id FROM tc JOIN ev USING (module, plane, tc_id)),
 j AS (SELECT *, coordinate - lag(coordinate) OVER (PARTITION BY module, ev_id, plane ORDER BY coordinate, seq) > 10 AS jump FROM h),
 q AS (SELECT *, sum(CASE WHEN jump THEN 1 ELSE 0 END) OVER (PARTITION BY module, ev_id, plane ORDER BY coordinate, seq ROWS UNBOUNDED PRECEDING) + 1 AS part FROM j),
 s AS (SELECT module, ev_id, {_part(0, 1)}, {_part(0, 2)}, {_part(1, 1)}, {_part(1, 2)},
 greatest(max(coordinate) FILTER (plane=0) - min(coordinate) FILTER (plane=0) + 1, max(coordinate) FILTER (plane=1) - min(coordinate) FILTER (plane=1) + 1) AS span FROM q GROUP BY ALL),
 f AS (SELECT *, b1 BETWEEN 0.8::DOUBLE * a1 AND 1.2::DOUBLE * a1 AS f11, b2 BETWEEN 0.8::DOUBLE * a2 AND 1.2::DOUBLE * a2 AS f22, b2 BETWEEN 0.8::DOUBLE * a1 AND 1.2::DOUBLE * a1 AS f12, b1 BETWEEN 0.8::DOUBLE * a2 AND 1.2::DOUBLE * a2 AS f21 FROM s)
 SELECT module, ev_id AS event, a1, a2, b1, b2, CASE WHEN span < 10 THEN 'whole' WHEN f11 AND f22 AND NOT f12 AND NOT f21 THEN CASE WHEN a2 = 0 AND b2 = 0 THEN 'whole' ELSE 'straight' END
 WHEN f12 AND f21 AND NOT f11 AND NOT f22 THEN 'crossed' ELSE 'discarded' END AS pairing FROM f""")
def match_split(spark, d):
    timed_hits = timed(spark, d)
    matched = M.gap_match(clusters(spark, d), ["module"], MINUTE, width=DAY).select("module", "plane", "time_cluster", "event")
    return M.split_events(timed_hits.join(matched, [*KEYS, "time_cluster"]), ["module", "event"], low=0.8, high=1.2)


@query("center_match", CLUSTERS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", pk AS (SELECT module, plane, time_start, time_end, (time_start + time_end)::DOUBLE / 2 AS c, time_start // {DAY} AS packet_id FROM clusters),
 o AS (SELECT *, row_number() OVER (PARTITION BY module, packet_id ORDER BY c, plane, time_start, time_end) AS i FROM pk),
 r AS (SELECT module, packet_id, i, time_start, plane, time_start AS s, time_end AS e, 0 AS event, CASE WHEN plane = 0 THEN 1 ELSE 2 END AS mask FROM o WHERE i = 1 UNION ALL
 SELECT module, packet_id, i, time_start, plane, CASE WHEN shut THEN time_start ELSE least(s, time_start) END, CASE WHEN shut THEN time_end ELSE greatest(e, time_end) END, CASE WHEN shut THEN event + 1 ELSE event END, CASE WHEN shut THEN bit ELSE mask | bit END
 FROM (SELECT o.*, r.s, r.e, r.event, r.mask, CASE WHEN o.plane = 0 THEN 1 ELSE 2 END AS bit, r.mask = 3 OR (r.mask & (CASE WHEN o.plane = 0 THEN 1 ELSE 2 END)) <> 0 OR greatest(r.s, o.time_start) - least(r.e, o.time_end) > {MINUTE} AS shut
 FROM r JOIN o ON o.module = r.module AND o.packet_id = r.packet_id AND o.i = r.i + 1))
 SELECT module, packet_id, time_start, plane, event FROM r""")
def center_match(spark, d):
    rows = clusters(spark, d).withColumns({"time_center": (F.col("time_start") + F.col("time_end")).cast("double") / 2, "packet_id": F.floor(F.col("time_start") / DAY)})
    return M.center_match(rows, ["module", "packet_id"], MINUTE)


@query("seed_cluster_2d", TIMED.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT module, plane, tc_id, seq, coordinate // 8 AS x, coordinate % 8 AS y, row_number() OVER (PARTITION BY module, plane, tc_id ORDER BY time, seq) AS i FROM tc),
 r AS (SELECT module, plane, tc_id, i, seq, seq AS seed, [{'seq': seq, 'x': x, 'y': y}] AS seeds FROM o WHERE i = 1 UNION ALL
 SELECT module, plane, tc_id, i, seq, coalesce(near.seq, seq), CASE WHEN near IS NULL THEN list_append(seeds, {'seq': seq, 'x': x, 'y': y}) ELSE seeds END
 FROM (SELECT o.*, r.seeds, list_filter(r.seeds, lambda s: (s.x - o.x) * (s.x - o.x) + (s.y - o.y) * (s.y - o.y) < 9)[1] AS near FROM r JOIN o ON o.module = r.module AND o.plane = r.plane AND o.tc_id = r.tc_id AND o.i = r.i + 1))
 SELECT module, plane, tc_id AS time_cluster, seq, seed FROM r""")
def seed_cluster_2d(spark, d):
    rows = timed(spark, d).withColumns({"x": F.floor(F.col("coordinate") / 8).cast("int"), "y": F.col("coordinate") % 8})
    return C.seed_clusters(rows, [*KEYS, "time_cluster"], 3)


@query("cluster_gaps", CLUSTERS + """, n AS (SELECT module, plane, tc_id, time_start, time_end, lead(time_start) OVER w AS s2, lead(time_end) OVER w AS e2 FROM clusters WINDOW w AS (PARTITION BY module ORDER BY time_start, plane))
 SELECT module, plane, time_start, greatest(least(time_end, e2) - greatest(time_start, s2) + 1, 0) AS overlap, greatest(greatest(time_start, s2) - least(time_end, e2), 0) AS gap FROM n WHERE s2 IS NOT NULL""")
def cluster_gaps(spark, d):
    rows = S.neighbour(clusters(spark, d), ["module"], ["time_start", "plane"], ["time_start", "time_end"], DAY, ahead=True).where("beside IS NOT NULL")
    a = [F.col(c) for c in ("time_start", "time_end", "beside.time_start", "beside.time_end")]
    return rows.select("module", "plane", "time_start", C.time_overlap(*a).alias("overlap"), C.time_gap(*a).alias("gap"))
