"""Queries: the reject rules of each instrument, over the same readouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import validate as V
from pulsegrid.operators.lookup import lookup
from pulsegrid.plans.catalog import query
from pulsegrid.plans.fixtures import READOUTS, readouts, table

c = F.col
RING = "fiber // 2"
OUT_OF_RING = f"NOT {RING} BETWEEN 0 AND {{}}"


def _rules(name: str, cases: list[tuple[str, str]], build, extra: str = "", relation: str = "readouts", prepare=None):
    """Register ``name``: SQL cases as (condition, reason), in order, and the rules as Columns."""
    when = " ".join(f"WHEN {condition} THEN '{reason}'" for condition, reason in cases)

    @query(name, f"WITH {READOUTS}{extra} SELECT packet_id, line, CASE {when} END AS reject_reason FROM {relation}")
    def run(spark, d):
        rows = readouts(spark, d)
        rows = prepare(spark, d, rows) if prepare else rows
        return V.with_reject(rows, build()).select("packet_id", "line", "reject_reason")

    return run


ZERO, HIGH = "amp_a + amp_b = 0", "amp_a + amp_b > {}"
_rules("validate_bifrost", [(OUT_OF_RING.format(8), "ring"), ("NOT fen BETWEEN 0 AND 9", "fen"), ("NOT grp BETWEEN 0 AND 5", "group"), (ZERO, "amplitude_zero"), (HIGH.format(400), "amplitude_high")],
       lambda: V.bifrost(c("fiber"), c("fen"), c("grp"), c("amp_a"), c("amp_b"), 8, 9, 5, 400))
_rules("validate_miracles", [(OUT_OF_RING.format(3), "ring"), (ZERO, "amplitude_zero"), (HIGH.format(450), "amplitude_high")], lambda: V.miracles(c("fiber"), c("amp_a"), c("amp_b"), 3, 450))
_rules("validate_cspec", [(OUT_OF_RING.format(11), "ring"), ("NOT fen BETWEEN 0 AND 11", "fen"), ("NOT grp BETWEEN 0 AND 5", "group")], lambda: V.cspec(c("fiber"), c("fen"), c("grp"), max_group=5))

BANKS = ", banks AS (SELECT CAST(n_nationkey AS INT) AS bank_ring, CAST(n_regionkey AS INT) AS bank, CAST(n_regionkey * 3 AS INT) AS bank_fens FROM nation WHERE n_nationkey < 9), b AS (SELECT r.*, bank, bank_fens FROM readouts r LEFT JOIN banks ON fiber // 2 = bank_ring)"


def _banks(spark, d, rows):
    banks = table(spark, d, "nation").where("n_nationkey < 9").select(c("n_nationkey").cast("int").alias("bank_ring"), c("n_regionkey").cast("int").alias("bank"), (c("n_regionkey") * 3).cast("int").alias("bank_fens"))
    return lookup(rows.withColumn("bank_ring", V.ring(c("fiber"))), banks, ["bank_ring"])


_rules("validate_loki", [(f"{RING} >= 12", "ring"), ("bank IS NULL", "bank"), ("fen >= bank_fens", "fen")], lambda: V.loki(c("fiber"), c("fen"), c("bank"), c("bank_fens")), BANKS, "b", _banks)
_rules("validate_tbl3he", [(OUT_OF_RING.format(11), "ring"), ("NOT grp BETWEEN 0 AND 3", "group"), ("bank IS NULL", "topology"), ("amp_a < 10 OR amp_b < 10", "amplitude_low"), (ZERO, "amplitude_zero")],
       lambda: V.tbl3he(c("fiber"), c("grp"), c("bank"), c("amp_a"), c("amp_b")), BANKS, "b", _banks)
_rules("validate_cdt", [(OUT_OF_RING.format(11), "ring"), ("NOT fen BETWEEN 0 AND 11", "fen"), ("bank IS NULL", "mapping")], lambda: V.cdt(V.ring(c("fiber")), c("fen"), c("bank")), BANKS, "b", _banks)
_rules("validate_cdt_compat", [(OUT_OF_RING.format(11), "ring"), ("NOT fen BETWEEN 0 AND 11", "fen"), (f"bank IS NULL OR {RING} >= 11 OR fen >= 11", "mapping")], lambda: V.cdt(V.ring(c("fiber")), c("fen"), c("bank"), compat=True), BANKS, "b", _banks)
_rules("validate_beam_monitor", [(OUT_OF_RING.format(11), "ring"), (f"{RING} <> 5", "monitor_ring"), ("NOT fen BETWEEN 0 AND 10", "fen"), ("bank IS NULL", "topology"), ("line % 3 + 1 <> bank % 3 + 1", "type"), ("line % 3 + 1 = 2 AND anode >= 100", "x"), ("line % 3 + 1 = 2 AND cathode >= 90", "y")],
       lambda: V.beam_monitor(V.ring(c("fiber")), c("fen"), 5, 10, c("bank"), c("line") % 3 + 1, c("bank") % 3 + 1, c("anode"), c("cathode"), F.lit(100), F.lit(90)), BANKS, "b", _banks)
_rules("validate_strip_threshold", [("adc < 100 + bank_fens", "adc_threshold")], lambda: V.adc_threshold(c("adc"), c("bank_fens") + 100), BANKS, "b", _banks)
_rules("validate_nmx", [(OUT_OF_RING.format(11), "ring"), ("NOT fen BETWEEN 0 AND 11", "fen"), ("bank IS NULL", "hybrid"), ("(adc & 1023) < 50", "adc"), ("channel >= 64", "channel")],
       lambda: V.nmx(V.ring(c("fiber")), c("fen"), c("bank"), c("adc").bitwiseAND(1023), c("channel"), 50), BANKS, "b", _banks)
_rules("validate_trex", [("bank IS NULL", "hybrid"), ("(adc & 1023) < 20 + bank_fens", "adc"), ("NOT channel BETWEEN 32 AND 63", "mapping")],
       lambda: V.trex(c("bank"), c("adc").bitwiseAND(1023), c("bank_fens") + 20, F.when(c("channel").between(32, 63), c("channel"))), BANKS, "b", _banks)
_rules("validate_timepix", [("anode >= 100", "x"), ("cathode >= 110", "y"), ("bank IS NULL", "no_global_time")], lambda: V.timepix(c("anode"), c("cathode"), 50, 55, 2, c("bank")), BANKS, "b", _banks)
