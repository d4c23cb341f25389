"""Queries: sinks, trigger pairing, chunked clustering and other small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import pixels as P
from pulsegrid.functions import timebase as T
from pulsegrid.operators import cluster as C
from pulsegrid.operators.stream_order import as_of
from pulsegrid.plans.catalog import query
from pulsegrid.plans.fixtures import DAY, HITS, MINUTE, READOUTS, hits, readouts, table
from pulsegrid.sources import sinks

c = F.col
H = "WITH " + HITS


@query("monitor_hit_messages", H + ", r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY time, seq) AS rn FROM hits) SELECT module, (rn - 1) // 100 AS chunk, to_json(list(plane ORDER BY rn))::VARCHAR AS plane, to_json(list(time ORDER BY rn))::VARCHAR AS time, to_json(list(coordinate ORDER BY rn))::VARCHAR AS coordinate, to_json(list(weight ORDER BY rn))::VARCHAR AS weight FROM r GROUP BY ALL")
def monitor_hit_messages(spark, d):
    out = sinks.hit_messages(hits(spark, d), 100, ["time", "seq"])
    return out.withColumns({n: F.to_json(n) for n in ("plane", "time", "coordinate", "weight")})


def _dense(plane: int, value: str, bins: int, name: str) -> str:
    return f"(SELECT k.module, to_json(list(coalesce(n, 0)::BIGINT ORDER BY i))::VARCHAR AS {name} FROM (SELECT DISTINCT module FROM hits WHERE plane = {plane}) k CROSS JOIN range({bins}) t(i) LEFT JOIN (SELECT module, {value} AS bin, count(*) AS n FROM hits WHERE plane = {plane} GROUP BY ALL) x ON x.module = k.module AND x.bin = t.i GROUP BY k.module)"


@query("monitor_histograms", H + f" SELECT * FROM {_dense(0, 'coordinate', 64, 'x_strips')} JOIN {_dense(1, 'coordinate', 64, 'y_strips')} USING (module) JOIN {_dense(0, 'weight >> 4', 32, 'x_adcs')} USING (module) JOIN {_dense(1, 'weight >> 4', 32, 'y_adcs')} USING (module)")
def monitor_histograms(spark, d):
    out = sinks.monitor_histograms(hits(spark, d), 64, 4, 32)
    return out.withColumns({n: F.to_json(n) for n in ("x_strips", "y_strips", "x_adcs", "y_adcs")})


@query("metric_lines", "SELECT 'monitor.' || event_type || ' ' || count(*) || ' 1700000000' AS line FROM events GROUP BY event_type")
def metric_lines(spark, d):
    counted = table(spark, d, "events").groupBy(c("event_type").alias("reason")).agg(F.count("*").alias("n"))
    return sinks.metric_lines(counted, "monitor", F.lit(1700000000))


_SIDES = H + ", e AS (SELECT time AS et, coordinate AS ev FROM hits WHERE module = 'view'), t AS (SELECT time AS tt, weight AS tv FROM hits WHERE module = 'click')"


@query("trigger_pairs", _SIDES + f" SELECT et AS arrival, ev, tv FROM e ASOF JOIN t ON e.et >= t.tt WHERE et - tt <= {5 * MINUTE} UNION ALL SELECT tt, ev, tv FROM t ASOF JOIN e ON t.tt >= e.et WHERE tt - et <= {5 * MINUTE}")
def trigger_pairs(spark, d):
    h = hits(spark, d)
    e = h.where("module = 'view'").select(c("time").alias("et"), c("coordinate").alias("ev"))
    t = h.where("module = 'click'").select(c("time").alias("tt"), c("weight").alias("tv"))
    one = as_of(e, t, "et", "tt", ["tv"], DAY).where(c("et") - c("tt") <= 5 * MINUTE).select(c("et").alias("arrival"), "ev", "tv")
    two = as_of(t, e, "tt", "et", ["ev"], DAY).where(c("tt") - c("et") <= 5 * MINUTE).select(c("tt").alias("arrival"), "ev", "tv")
    return one.unionByName(two)


@query("global_time", _SIDES + " SELECT seq, time, tt, tv FROM hits ASOF LEFT JOIN t ON hits.time >= t.tt WHERE module = 'purchase'")
def global_time(spark, d):
    h = hits(spark, d)
    t = h.where("module = 'click'").select(c("time").alias("tt"), c("weight").alias("tv"))
    return as_of(h.where("module = 'purchase'"), t, "time", "tt", ["tv"], DAY).select("seq", "time", "tt", "tv")


@query("chunked_clusters", H + f""", k AS (SELECT *, coordinate // 8 // 4 + 2 * (coordinate % 8 // 4) AS chunk FROM hits),
 f AS (SELECT *, time - lag(time) OVER (PARTITION BY module, chunk ORDER BY time, seq) AS gap FROM k), i AS (SELECT *, max(CASE WHEN gap IS NULL OR gap > {5 * MINUTE} THEN time END) OVER (PARTITION BY module, chunk ORDER BY time, seq ROWS UNBOUNDED PRECEDING) AS time_cluster FROM f)
 SELECT module, chunk::BIGINT AS chunk, time_cluster, count(*) AS n, CAST(sum(weight) AS BIGINT) AS tot FROM i GROUP BY ALL HAVING count(*) >= 2 AND sum(weight) >= 20 AND max(time) - min(time) >= 1000""")
def chunked_clusters(spark, d):
    h = hits(spark, d).withColumn("chunk", C.chunk_index(F.floor(c("coordinate") / 8), c("coordinate") % 8, 4, 2).cast("long"))
    clusters = C.time_clusters(h, ["module", "chunk"], 5 * MINUTE, width=DAY).groupBy("module", "chunk", "time_cluster")
    stats = clusters.agg(F.count("*").alias("n"), F.sum("weight").alias("tot"), (F.max("time") - F.min("time")).alias("span"))
    return stats.where("n >= 2 AND tot >= 20 AND span >= 1000").drop("span")


@query("unit_conversions", "SELECT p_partkey, CASE WHEN p_size <> 1 THEN CAST(trunc(1e9::DOUBLE / (p_size - 1)) AS BIGINT) END AS period_ns, CASE WHEN p_partkey <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(p_partkey::DOUBLE))) AS BIGINT) END AS next_power FROM part")
def unit_conversions(spark, d):
    return table(spark, d, "part").select("p_partkey", T.hz_to_ns(c("p_size") - 1).alias("period_ns"), P.next_power_of_two(c("p_partkey")).alias("next_power"))


@query("tick_quantised_time", "WITH t AS (SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS ns FROM events), k AS (SELECT event_id, ns // 1000000000 AS s, CAST(round((ns % 1000000000) / (1e9::DOUBLE / 88052500)) AS BIGINT) AS k FROM t) SELECT event_id, (s + CASE WHEN k >= 88052500 THEN 1 ELSE 0 END) * 1000000000 + CAST(trunc((k - CASE WHEN k >= 88052500 THEN 88052500 ELSE 0 END) * (1e9::DOUBLE / 88052500)) AS BIGINT) AS ns FROM k")
def tick_quantised_time(spark, d):
    from pulsegrid.plans.fixtures import micros

    return table(spark, d, "events").select("event_id", T.quantised(micros("ts") * 1000 + c("event_id") % 1000).alias("ns"))


@query("monitor_normalised", "WITH " + READOUTS + " SELECT packet_id, line, CASE WHEN line % 2 = 0 AND amp_c <> 0 THEN adc // amp_c ELSE adc END::BIGINT AS npos FROM readouts")
def monitor_normalised(spark, d):
    from pulsegrid.sources.decode import normalised

    return readouts(spark, d).select("packet_id", "line", normalised(c("adc"), c("amp_c"), c("line") % 2 == 0).cast("long").alias("npos"))


@query("tube_sources", "WITH " + READOUTS + " SELECT 'arc=' || ((grp // 3)) || ';triplet=' || (grp % 3 + 3 * (fiber // 2)) AS source, count(*) AS n FROM readouts GROUP BY ALL")
def tube_sources(spark, d):
    from pulsegrid.functions.validate import ring

    name = F.concat(F.lit("arc="), T.div(c("grp"), 3).cast("string"), F.lit(";triplet="), (c("grp") % 3 + 3 * ring(c("fiber"))).cast("string"))
    return readouts(spark, d).groupBy(name.alias("source")).agg(F.count("*").alias("n"))


@query("part_offsets", "WITH " + READOUTS + " SELECT packet_id, line, CASE WHEN anode < 100 THEN anode + 1 + 720896 END::BIGINT AS pixel_id, CASE WHEN anode < 100 THEN anode + 1 + 245760 ELSE 245760 END::BIGINT AS compat_id FROM readouts")
def part_offsets(spark, d):
    pixel = P.pixel2d(c("anode"), F.lit(0), 100, 1)
    return readouts(spark, d).select("packet_id", "line", P.in_part(pixel, "sans").alias("pixel_id"), P.in_part(pixel, "pa", compat=True).alias("compat_id"))
