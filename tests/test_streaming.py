"""A stream over all input gives what the batch operator gives."""

import random

from pyspark.sql import functions as F

from pulsegrid.functions import validate as V
from pulsegrid.operators import cluster as C
from pulsegrid.streaming import stateful


def stream(spark, tmp_path, rows, schema, parts):
    """File stream that reads ``parts`` micro-batches in order."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def collected(spark, df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_clusters_span_micro_batches(spark, tmp_path):
    r = random.Random(1)
    t, rows = 0, []
    for i in range(120):
        t += r.choice([1, 2, 9])
        rows.append((i, t, r.randrange(64), r.randrange(1, 9), 0, "m"))
    schema = "seq long, time long, coordinate int, weight int, plane int, module string"
    out = collected(spark, stateful.open_clusters(stream(spark, tmp_path, rows, schema, 4), 5), tmp_path, "clusters")
    batch = C.cluster_stats(C.time_clusters(spark.createDataFrame(rows, schema), ["module", "plane"], 5), ["module", "plane", "time_cluster"]).collect()
    expected = sorted((b.time_start, b.time_end, b.n, b.w, b.wc) for b in batch)
    assert sorted((o.time_start, o.time_end, o.n, o.w, o.wc) for o in out) == expected[:-1]  # the last is still open


def test_sequence_gaps(spark, tmp_path):
    seqs = [0, 1, 3, 4, 4, 5, 9]
    rows = [(0, s, i) for i, s in enumerate(seqs)]
    out = collected(spark, stateful.sequence_gaps(stream(spark, tmp_path, rows, "queue int, seq long, arrival long", 3)), tmp_path, "gaps", "update")
    assert max((o.packets, o.errors) for o in out) == (7, 3)


def test_trigger_pairs(spark, tmp_path):
    rows = [("s", "evr", 0, 1, 100), ("s", "tdc", 5, 1, 7), ("s", "evr", 50, 2, 200), ("s", "tdc", 52, 4, 8), ("s", "tdc", 53, 4, 9)]
    out = collected(spark, stateful.pair_triggers(stream(spark, tmp_path, rows, "source string, side string, arrival long, counter long, value long", 2), 20), tmp_path, "pairs")
    assert sorted((o.arrival, o.pulse, o.trigger, o.missed) for o in out) == [(5, 100, 7, 0), (52, 200, 8, 2)]


def test_merge_holds_back_until_the_horizon(spark, tmp_path):
    rows = [("g", "a", 5, 1), ("g", "b", 4, 2), ("g", "c", 3, 3), ("g", "c", 6, 4), ("g", "b", 7, 5), ("g", "a", 8, 6)]
    out = collected(spark, stateful.merge_in_order(stream(spark, tmp_path, rows, "grp string, module string, time long, pixel long", 3), ["a", "b", "c"], 0), tmp_path, "merged")
    assert sorted(o.time for o in out) == [3, 4, 5]


def test_counters_sink_is_idempotent(spark, tmp_path):
    write = stateful.counters_sink(str(tmp_path / "counters"))
    batch = V.with_reject(spark.range(6).select(F.col("id").alias("v")), [("low", F.col("v") < 2)])
    write(batch, 0)
    write(batch, 0)
    assert {r.reason: r.n for r in spark.read.parquet(str(tmp_path / "counters")).collect()} == {"low": 2, "ok": 4}


def test_guard_closes_long_clusters(spark, tmp_path):
    rows = [(i, i, 1, 1, 0, "m") for i in range(10)]
    out = collected(spark, stateful.open_clusters(stream(spark, tmp_path, rows, "seq long, time long, coordinate int, weight int, plane int, module string", 1), 5, most_open=4), tmp_path, "guarded")
    assert [o.n for o in sorted(out, key=lambda o: o.time_start)] == [4, 4]
