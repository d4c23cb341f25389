"""Operator 5: uniform shuffle into shards of exact size, from a hypergeometric communication matrix.

1. The rows are written once with the number of the input partition that held each and its place there. From then on
   the input partition of a row is data, so a lost executor or another plan cannot change it.
2. From the partitions' row counts, the exact number of rows that each sends to each shard is drawn: the counts of a
   uniform permutation follow the multivariate hypergeometric law. The matrix has partitions x shards entries.
3. Local permutation: a partition deals its row of the matrix, as shuffled labels, to its rows in turn.
4. Exchange and second permutation: within a shard rows are ordered by a random 64-bit key. The key's leading bits cut a
   shard into many equal cells, so no task gets a whole shard; a cell's first slot is the sum of the cells before it.

Law: ``rows``; shard sizes differ by one row at most. Groups of equal texts are dealt like all other rows.
Cases: a null text has size 1 and the crc32 of nothing, 0; null or repeated doc_ids are rows like others; an empty table
gives an empty result; a long text moves as its digests alone; equal keys of the order are told apart by place; shard_rows()
keeps extra columns, whatever their names, but for shard and slot, which it sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pulsegrid.llm.common import as_rows, documents, materialise

PLACE = "_place"
#: Numpy draws hypergeometric numbers of fewer rows than this.
EASY = 10**9


def _log_error(n: float) -> float:
    """log(n!) less Stirling's approximation of it."""
    return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n < 16 else (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n


def _deviance(x: float, mean: float) -> float:
    """x * log(x / mean) + mean - x, without loss of digits where the two are close."""
    if abs(x - mean) > 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, power, j = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        more = total + power / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _log_binomial(x: int, n: int, p: float) -> float:
    """Logarithm of the binomial probability, to full precision for any n."""
    if x == 0 or x == n:
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    return _log_error(n) - _log_error(x) - _log_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good, of any number of rows.

    Below 10**9 rows numpy draws it. Beyond, a rejection method for log-concave laws does: its proposal is flat around the
    mode with exponential tails, and it accepts by the exact ratio of probabilities to the mode's.
    """
    if good + bad < EASY:
        return int(rng.hypergeometric(good, bad, drawn))
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    p = drawn / (good + bad)

    def log_p(x: int) -> float:
        return _log_binomial(x, good, p) + _log_binomial(drawn - x, bad, p) - _log_binomial(drawn, good + bad, p) if p < 1 else 0.0

    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), least), most)
    at_mode = log_p(mode)
    height = math.exp(at_mode)
    w = 1 + height / 2
    while True:
        u, v, test, sign = rng.random(4)
        y = v * w / height if u <= w / (1 + w) else (w - math.log1p(-v)) / height
        x = mode + round(y) * (1 if sign < 0.5 else -1)
        if least <= x <= most and math.log(max(test, 1e-300)) + min(0.0, w - height * y) <= log_p(x) - at_mode:
            return x


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard; row sums are ``counts``, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = np.array([total // shards + (j < total % shards) for j in range(shards)], dtype=np.int64)
    matrix = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        rest = int(left.sum())
        for j in range(shards):  # shard by shard, of the rows and places that the shards before left
            rest -= int(left[j])
            matrix[i, j] = hypergeometric(rng, int(left[j]), rest, n)
            n -= int(matrix[i, j])
        left -= matrix[i]
    return matrix


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 20240501, cell_rows: int = 20_000) -> DataFrame:
    """``df`` with columns shard and slot: a uniform permutation of all rows, cut into shards of equal size."""
    rows = materialise(as_rows(df).withColumn(PLACE, F.monotonically_increasing_id()), "shard-rows")
    counts = {r["part"]: r["n"] for r in rows.groupBy(F.shiftright(PLACE, 33).alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    parts = sorted(counts)
    matrix = dict(zip(parts, communication_matrix([counts[p] for p in parts], shards, seed)))
    bits = min(30, max(4, math.ceil(math.log2(max(1, sum(counts.values()) / shards / cell_rows)))))

    @F.pandas_udf(IntegerType())
    def deal(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, labels = None, None
        for place in series:
            part, at, out = place.to_numpy() >> 33, place.to_numpy() & (2**33 - 1), np.zeros(len(place), dtype=np.int32)
            for p in np.unique(part):
                if p != held:
                    held, labels = p, np.repeat(np.arange(shards, dtype=np.int16), matrix[p])
                    np.random.default_rng([seed, p]).shuffle(labels)
                out[part == p] = labels[at[part == p]]
            yield pd.Series(out)

    dealt = rows.withColumn("shard", deal(PLACE)).withColumn("_key", F.xxhash64(F.lit(seed), PLACE)).withColumn("_cell", F.shiftrightunsigned("_key", 64 - bits))
    dealt = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_key", PLACE)))
    keys = rows.select(PLACE).withColumn("shard", deal(PLACE)).withColumn("_cell", F.shiftrightunsigned(F.xxhash64(F.lit(seed), PLACE), 64 - bits))
    sizes = keys.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")]
    return dealt.join(starts, ["shard", "_cell"]).select(*kept, "shard", (F.col("_start") + F.col("_rank") - 1).alias("slot"))


def op5_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digests = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(digests)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
