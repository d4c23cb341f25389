"""Streaming operators with state: cross-packet clusters, trigger pairing, sequence gaps and horizon merge.

Times are LONG nanoseconds kept in state; Spark's microsecond watermarks are not used for them. State per key is bounded by
what is still open; ``most_open`` is an optional guard (off by default) that closes a cluster after that many hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CLUSTER = "module string, plane int, time_start long, time_end long, n long, w long, wc long, coord_start int, coord_end int"


def open_clusters(hits: DataFrame, gap: int, most_open: int | None = None) -> DataFrame:
    """Time clusters per (module, plane) that may go on in later micro-batches; a cluster is put out when it is closed.

    ``hits`` is a stream of module, plane, time, seq, coordinate, weight. A hit earlier than the open cluster's last hit
    opens a new cluster, as an out-of-order hit does in the batch rule for unsigned times.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = list(state.get) if state.exists else None
        closed = []
        for frame in frames:
            for r in frame.sort_values(["time", "seq"]).itertuples():
                if current is not None and (r.time - current[1] > gap or r.time < current[1] or (most_open and current[2] >= most_open)):
                    closed.append((*key, *current))
                    current = None
                if current is None:
                    current = [r.time, r.time, 0, 0, 0, r.coordinate, r.coordinate]
                current = [current[0], r.time, current[2] + 1, current[3] + r.weight, current[4] + r.weight * r.coordinate, min(current[5], r.coordinate), max(current[6], r.coordinate)]
        if current is not None:
            state.update(tuple(int(x) for x in current))
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in CLUSTER.split(", ")])

    kept = "time_start long, time_end long, n long, w long, wc long, coord_start int, coord_end int"
    return hits.groupBy("module", "plane").applyInPandasWithState(run, CLUSTER, kept, "append", GroupStateTimeout.NoTimeout)


def pair_triggers(records: DataFrame, tolerance: int = 20_000_000) -> DataFrame:
    """Pairs of pulse records (side ``evr``) and trigger records (side ``tdc``) of a source, by arrival time.

    The latest of each side is kept. A pair is put out on every arrival whose other side is at most ``tolerance`` away.
    A record whose counter equals the last accepted one is dropped, as is one below it, unless it is 0 or 1; gaps are counted.
    ``records``: source, side, arrival, counter, value.
    """
    out = "source string, arrival long, pulse long, trigger long, missed long, dropped long"
    kept = "evr_at long, evr long, evr_counter long, tdc_at long, tdc long, tdc_counter long, missed long, dropped long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = list(state.get) if state.exists else [-1, -1, -1, -1, -1, -1, 0, 0]
        rows = []
        for frame in frames:
            for r in frame.sort_values(["arrival", "side"]).itertuples():
                at = 0 if r.side == "evr" else 3
                last = s[at + 2]
                if last >= 0 and (r.counter == last or (r.counter < last and r.counter not in (0, 1))):
                    s[7] += 1
                    continue
                if last >= 0 and r.counter > last + 1:
                    s[6] += r.counter - last - 1
                s[at : at + 3] = [r.arrival, r.value, r.counter]
                if s[0] >= 0 and s[3] >= 0 and abs(s[0] - s[3]) <= tolerance:
                    rows.append((key[0], r.arrival, s[1], s[4], s[6], s[7]))
        state.update(tuple(int(x) for x in s))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return records.groupBy("source").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def sequence_gaps(packets: DataFrame) -> DataFrame:
    """Per queue: packets, and sequence numbers that were not the expected one (0 first; after an error, the received one goes on).

    ``packets``: queue, seq, arrival. Update mode: the running totals of each queue after each micro-batch.
    """
    out = "queue int, packets long, errors long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, packets_, errors = state.get if state.exists else (0, 0, 0)
        for frame in frames:
            for seq in frame.sort_values("arrival").seq:
                errors += int(seq != expected)
                expected, packets_ = int(seq) + 1, packets_ + 1
        state.update((expected, packets_, errors))
        yield pd.DataFrame([(key[0], packets_, errors)], columns=["queue", "packets", "errors"])

    return packets.groupBy("queue").applyInPandasWithState(run, out, "expected long, packets long, errors long", "update", GroupStateTimeout.NoTimeout)


def merge_in_order(events: DataFrame, modules: list[str], latency: int) -> DataFrame:
    """Rows of all modules of a group in time order, held until every module has moved on by more than ``latency``.

    ``events``: grp, module, time, pixel. State holds each module's latest time and the rows not yet released.
    """
    out = "grp string, time long, module string, pixel long"
    kept = "latest array<long>, held_time array<long>, held_module array<string>, held_pixel array<long>"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest, t, m, p = (list(x) for x in state.get) if state.exists else ([-1] * len(modules), [], [], [])
        for frame in frames:
            for r in frame.itertuples():
                i = modules.index(r.module)
                latest[i] = max(latest[i], int(r.time))
                t.append(int(r.time))
                m.append(r.module)
                p.append(int(r.pixel))
        horizon = min(latest) - latency
        rows = sorted(zip(t, m, p))
        ready, held = [r for r in rows if r[0] < horizon], [r for r in rows if r[0] >= horizon]
        state.update((latest, [r[0] for r in held], [r[1] for r in held], [r[2] for r in held]))
        yield pd.DataFrame([(key[0], *r) for r in ready], columns=["grp", "time", "module", "pixel"])

    return events.groupBy("grp").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def counters_sink(path: str):
    """foreachBatch function: appends the micro-batch's reject counters to a Parquet folder, keyed by batch id.

    A repeated micro-batch overwrites its own folder, so counts are not doubled after a failure.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
