"""Operator 10: canonical exact digests.

A text's canonical form is NFKC, case-folded, NFKC again, with runs of white space folded to one space and none at the
ends. Its fingerprint is the 128-bit xxh3 of that form in hexadecimal. Texts whose digests meet are compared byte by byte;
if two different forms share a digest, all but the first in byte order get a numbered suffix.

Comparing is limited to digests that occur more than once. A bitmap of fixed size over digest bits picks the texts to
compare; a bit shared by chance only lets more texts through.

Likeness of two fingerprints is 1 if the canonical forms are equal and 0 otherwise.
Cases: a null text counts as empty; null doc_ids come last in descending order; rows with equal doc_id are ordered by text;
a single row is its own next document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pulsegrid.llm.common import column, documents

MAP_BITS = 23


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "replace")


def digest(form: bytes, bits: int = 128) -> str:
    """The leading ``bits`` bits of the digest; fewer than 128 only to force collisions in tests."""
    return f"{xxhash.xxh3_128_intdigest(form) >> (128 - bits):0{(bits + 3) // 4}x}"


def _slot(fingerprint: str) -> int:
    return xxhash.xxh3_64_intdigest(fingerprint) & (2**MAP_BITS - 1)


def collided(docs: DataFrame, bits: int = 128) -> DataFrame:
    """(fingerprint, form, variant): canonical forms beyond the first that share a digest; almost surely empty.

    ``docs`` has a column text. Digests are counted first; then only the forms of repeated digests are grouped by
    digest and bytes. Equal forms collapse before the shuffle.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(canonical(t or ""), bits) for t in column(batch, "text")]
            yield pa.RecordBatch.from_pydict({"fingerprint": found, "slot": pa.array([_slot(f) for f in found], pa.int32())}, schema=pa.schema([("fingerprint", pa.string()), ("slot", pa.int32())]))

    repeated = docs.select("text").mapInArrow(keys, "fingerprint string, slot int").groupBy("fingerprint", "slot").agg(F.count("*").alias("n")).where("n > 1")
    words = repeated.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1, slot & 31)")).alias("bits")).collect()  # at most 2^18 rows
    bitmap = np.zeros(2 ** (MAP_BITS - 5), dtype=np.uint32)
    for word, found in words:
        bitmap[word] = found & 0xFFFFFFFF

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text in column(batch, "text"):
                form = canonical(text or "")
                slot = _slot(key := digest(form, bits))
                if bitmap[slot >> 5] >> np.uint32(slot & 31) & np.uint32(1):
                    kept.append((key, form))
            yield pa.RecordBatch.from_pydict({"fingerprint": [k for k, _ in kept], "form": [f for _, f in kept]}, schema=pa.schema([("fingerprint", pa.string()), ("form", pa.binary())]))

    distinct = docs.select("text").mapInArrow(forms, "fingerprint string, form binary").groupBy("fingerprint", "form").agg(F.count("*").alias("n"))
    shared = distinct.groupBy("fingerprint").agg(F.count("*").alias("forms")).where("forms > 1").select("fingerprint")
    if shared.isEmpty():
        return docs.sparkSession.createDataFrame([], "fingerprint string, form binary, variant int")
    ranked = distinct.join(shared, "fingerprint").withColumn("variant", F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")) - 1)
    return ranked.where("variant > 0").select("fingerprint", "form", "variant")


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows (bucket, ghost, doc_id, text), sorted, in which each document is followed by the next in descending doc_id order.

    doc_ids are cut into ranges, a partition each. The first document of a range is also sent, as a ghost, to the end of the
    range before it, and that of the first range to the last. Ranges are found from the doc_ids alone; the driver holds one row a range.
    """
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / partitions for i in range(1, partitions)], 10_000)).first()[0] if partitions > 1 else []
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))
    last = len(cuts) + 1  # null doc_ids

    @F.pandas_udf(IntegerType())
    def bucket(doc_id: pd.Series) -> pd.Series:
        null = doc_id.isna().to_numpy()
        known = doc_id.fillna(0).astype("int64").to_numpy() if not null.any() else np.array([0 if pd.isna(x) else int(x) for x in doc_id], dtype=np.int64)
        return pd.Series(np.where(null, last, len(cuts) - np.searchsorted(cuts, known, side="right")).astype(np.int32))

    heads = sorted(ids.withColumn("bucket", bucket("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    rows = docs.select(bucket("doc_id").alias("bucket"), F.lit(0).alias("ghost"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not heads:
        return rows
    home = docs.sparkSession.createDataFrame([(h["head"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)], "head long, home int")
    first = docs.join(F.broadcast(home), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("home", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    ghosts = first.select(F.col("home").alias("bucket"), F.lit(1).alias("ghost"), "doc_id", "text")
    return rows.unionByName(ghosts).repartitionById(last + 1, "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), "text")


def edited_text(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses; see the module's text."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clashes = collided(docs, bits)
    keep_forms = not clashes.isEmpty()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            out = []
            for ghost, doc_id, text in zip(column(batch, "ghost"), column(batch, "doc_id"), column(batch, "text")):
                form = canonical(text)
                if waiting:
                    before_id, before, before_form = waiting
                    edited = edited_text(before, text)
                    edited_form = canonical(edited)
                    out.append((before_id, len(before), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), digest(before_form, bits), digest(edited_form, bits), float(before_form == edited_form), float(before_form == form), *((before_form, edited_form) if keep_forms else ())))
                waiting = None if ghost else (doc_id, text, form)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    names = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(names + ([("form", pa.binary()), ("edited_form", pa.binary())] if keep_forms else []))
    rows = with_next(docs, max(1, 4 * partitions)).mapInArrow(compare, OUT + (", form binary, edited_form binary" if keep_forms else ""))
    if not keep_forms:
        return rows
    for name, form in (("fingerprint", "form"), ("edited_fingerprint", "edited_form")):
        rows = rows.join(clashes.select(F.col("fingerprint").alias(name), F.col("form").alias(form), "variant"), [name, form], "left")
        rows = rows.withColumn(name, F.concat(name, F.coalesce(F.concat(F.lit("-"), F.col("variant").cast("string")), F.lit("")))).drop("variant")
    return rows.select(*[n for n, _ in names])


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
