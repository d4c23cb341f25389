"""Operator 1: token-id files with Elias-Fano document boundaries.

A store is a folder of Parquet part files whose rows are binary segments in ascending doc_id order. A segment holds a
run of documents: their ids concatenated as little-endian unsigned integers (16 bits where the vocabulary allows it), the
document boundaries as an Elias-Fano sequence, and the doc_ids as another. Spark's writer commits the files, so a lost
executor leaves no half-written segment, and any file system that Spark knows will do.

Layout of a segment, little-endian: ``EFT1``, u32 documents, u32 null doc_ids (these come first), u8 bytes an id,
3 bytes of zero, i64 least doc_id, u64 ids, u64 length of the doc_id sequence, u64 length of the boundary sequence, then
the doc_id sequence, the boundary sequence and the ids.

Cases: a null or empty text holds the end id alone; null doc_ids come first; repeated doc_ids stand side by side, ordered
by text; an empty table gives an empty store; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import column, documents, shared_path, text_groups, word_tokenizer

HEADER = struct.Struct("<4sIIB3xqQQQ")
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of n integers below u in about n * (2 + log2(u / n)) bits, with constant-time access.

    Each value's low bits stand in a packed array; its high part is one set bit in a unary bit vector. The place of every
    64th set bit is kept, so select() scans a few bytes from the nearest sample.
    """

    PREFIX = struct.Struct("<QBQQ")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(places[-1]) + 1) if n else 0, dtype=np.uint8)
        unary[places] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.PREFIX.pack(self.n, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> EliasFano:
        n, width, low, high = cls.PREFIX.unpack_from(blob)
        at = cls.PREFIX.size
        return cls(n, width, np.frombuffer(blob, np.uint8, low, at), np.frombuffer(blob, np.uint8, high, at + low), np.frombuffer(blob, "<u4", offset=at + low + high))

    def select(self, i: int) -> int:
        """The place of the i-th set bit of the unary vector."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        skipped = int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: at % 8].sum())
        left += skipped
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little"))
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left -= len(ones)
            byte += 64

    def __getitem__(self, i: int) -> int:
        """The i-th value, from the packed bits alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.width
        window = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.width]
        low = sum(int(b) << k for k, b in enumerate(window))
        return (self.select(i) - i) << self.width | low

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.uint64)
        low = (bits << np.arange(self.width, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)) | low


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], id_bytes: int) -> bytes:
    """One segment of documents in ascending doc_id order, null ids first."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    keys = EliasFano.build(known.astype(np.uint64) - np.uint64(base & (2**64 - 1))).to_bytes()
    ends = EliasFano.build(np.cumsum([len(x) for x in ids])).to_bytes()
    flat = np.concatenate(ids)
    if len(flat) and int(flat.max()) >> (8 * id_bytes):
        raise ValueError(f"id {int(flat.max())} does not fit in {id_bytes} bytes")
    flat = flat.astype(f"<u{id_bytes}")
    return HEADER.pack(b"EFT1", len(doc_ids), len(doc_ids) - len(known), id_bytes, base, len(flat), len(keys), len(ends)) + keys + ends + flat.tobytes()


class Segment:
    """Reads a segment; a document's ids are a slice of the concatenated array between two selected boundaries."""

    def __init__(self, blob: bytes):
        magic, self.n_docs, self.n_null, self.id_bytes, self.base, self.n_ids, keys, ends = HEADER.unpack_from(blob)
        if magic != b"EFT1":
            raise ValueError("not a token segment")
        at = HEADER.size
        self.keys, self.ends = EliasFano.from_bytes(blob[at : at + keys]), EliasFano.from_bytes(blob[at + keys : at + keys + ends])
        self.ids = np.frombuffer(blob, f"<u{self.id_bytes}", self.n_ids, at + keys + ends)

    def doc_ids(self) -> list[int | None]:
        known = (self.keys.values() + np.uint64(self.base & (2**64 - 1))).astype(np.int64)
        return [None] * self.n_null + known.tolist()

    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], self.ends.values().astype(np.int64)])

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document by random access."""
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]


SEGMENTS = "part int, seq int, part_start long, n_docs int, n_tokens long, segment binary"


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment_ids: int = 1_000_000) -> None:
    """Tokenise ``docs`` (doc_id, text) and write a store at ``path``; an id takes 1, 2 or 4 bytes, as the vocabulary and the end id need.

    One shuffle range-partitions the texts by doc_id, and by the start of the text where many rows have one doc_id or none; a task
    then streams its sorted rows and cuts a segment whenever ``segment_ids`` ids are gathered, so it holds one segment at a time.
    """
    most = max(end_id, *word_tokenizer(tokenizer).model.get_vocab().values())
    id_bytes = next(n for n in (1, 2, 4) if most < 256**n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_tokenizer(tokenizer), np.array([end_id], dtype="<u4")
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        keys, held, count = [], [], 0

        def cut():
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "part_start": [start], "n_docs": [len(keys)], "n_tokens": [count], "segment": [pack_segment(keys, held, id_bytes)]}, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("segment", pa.binary())])
        for batch in batches:
            doc_ids, texts = column(batch, "doc_id"), batch.column(batch.schema.get_field_index("text"))
            for group in text_groups(texts):
                for doc_id, found in zip(doc_ids[group], words.encode_all(texts[group])):
                    ids = np.concatenate([found, end])
                    keys.append(doc_id)
                    held.append(ids)
                    count += len(ids)
                    if count >= segment_ids:
                        yield cut()
                        seq, start, keys, held, count = seq + 1, start + count, [], [], 0
        if keys:
            yield cut()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a store with digests of their ids: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the segment's place in its part plus the ids of all earlier parts; that sum runs over one row a part.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, blob in zip(column(batch, "part"), column(batch, "part_start"), column(batch, "segment")):
                segment = Segment(blob)
                bounds = segment.bounds()
                wide = segment.ids.astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * segment.n_docs, pa.int32()), "doc_id": pa.array(segment.doc_ids(), pa.int64()),
                    "local_start": pa.array(bounds[:-1] + start, pa.int64()), "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64()),
                })

    store = spark.read.schema(SEGMENTS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = store.select("part", "part_start", "segment").mapInArrow(decode, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(parts, "part").select("doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-store")
    write_store(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_store(spark, path)
