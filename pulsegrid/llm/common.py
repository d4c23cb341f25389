"""Shared helpers: tables in the shared folder, and bounded word caches for tokenizers."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A local session that sets none gets a folder of its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    Row groups are small, so that a task which writes long texts holds few of them.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).option("parquet.block.size", 16 * 2**20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within it, actions of this session hand Python at most ``rows`` rows at a time (or fewer, if it is set so).

    Arrow keeps a buffer of a batch's size for each thread that ever wrote one, outside the heap; texts are long, so batches are short.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or ``name`` after as many underscores as make it differ from all ``columns`` (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_rows(df: DataFrame, *needed: str) -> DataFrame:
    """(row, *needed): every row of ``df`` as one struct beside the columns that an operator reads.

    The operator's own columns then clash with none of the table's, whatever their names; ``select("row.*")`` restores them.
    """
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *needed)


#: A bitmap has at most 2**MAP_WORDS words of 64 bits (it is broadcast: some tens of MB at most), and about 16 bits an id.
MAP_WORDS = 18


def marked(df: DataFrame, ids: DataFrame, name: str = "marked") -> DataFrame:
    """``df`` with a boolean: false only if its doc_id is not among ``ids`` (doc_id); null doc_ids are never marked.

    The ids set bits of a bitmap sized from their count. With more than four ids a word the bitmap would be full, so every row is marked,
    and what follows (a join on doc_id) does the work.
    """
    count = ids.count()
    known = F.col("doc_id").isNotNull()
    if count > 4 * 2**MAP_WORDS:
        return df.withColumn(name, known)
    words = min(MAP_WORDS, max(6, math.ceil(math.log2(max(1, count / 4)))))
    bit, word = F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))"), F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - words)
    bitmap = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = df.withColumn("_at", word).join(F.broadcast(bitmap), F.col("_at") == F.col("_word"), "left")
    return found.withColumn(name, known & (F.coalesce("_bits", F.lit(0)).bitwiseAND(bit) != 0)).drop("_at", "_word", "_bits")


#: Keys with more than a MOST-th of all rows are fewer than MOST, so they can always be broadcast.
MOST = 20_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, df: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and in ``df`` how many of the ``total`` rows have it.

    Frequent keys (fewer than MOST) are broadcast; the rest, at most total / MOST rows each, are joined by a shuffle. No task
    gets all rows of a frequent key.
    """
    frequent = F.col(df) * F.lit(MOST) > F.lit(total)
    tried = rows.join(F.broadcast(table.where(frequent)), key, "left")
    rest = tried.where(F.col(df).isNull()).select(*rows.columns)
    return tried.where(F.col(df).isNotNull()).unionByName(rest.join(table.where(~frequent), key))


def release_memory() -> None:
    """Give a Python worker's free memory back at the end of a task: workers wait for the next one beside the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, each distinct white-space chunk encoded once.

    ASCII white space always ends a match of the tokenizer's pattern and blocks Unicode composition, and the tokenizer
    lower-cases, so a text's ids are those of its lower-cased chunks in order. New chunks go to the library many at a time:
    a chunk of letters a-z is one match, so its ids end with the first that ends a word; the others are joined by a
    separator whose one id cuts the result. A stop or comma after a letter is a match of its own, so such a chunk's ids are
    those of the chunk before it and of the mark. The cache is emptied when it reaches ``limit`` chunks, which bounds memory and
    changes no result; chunks beyond 256 bytes are encoded but not kept.
    """

    SEPARATOR = b"\x01"

    def __init__(self, path: str, limit: int = 900_000):
        from tokenizers import Tokenizer

        self.model, self.limit, self.kept = Tokenizer.from_file(path), limit, {}
        (self.cut,) = self._ids(self.SEPARATOR)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, chunk: bytes) -> list[int]:
        return self.model.encode(chunk.decode(), add_special_tokens=False).ids

    def _joined(self, chunks: list[bytes], between: bytes, many: int = 256) -> list[np.ndarray]:
        groups = [between.join(chunks[i : i + many]).decode() for i in range(0, len(chunks), many)]
        return [np.array(e.ids, dtype="<u4") for e in self.model.encode_batch(groups, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk as bytes."""
        words = [c for c in chunks if c.isalpha()]
        marked = [c for c in chunks if c and not c.isalpha() and self.SEPARATOR not in c]
        found = {b"": b""}
        if words:
            ids = np.concatenate(self._joined(words, b" "))
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            found |= zip(words, map(raw.__getitem__, map(slice, [0, *stops], stops)))
        if marked:
            ids = np.concatenate([np.append(g, self.cut) for g in self._joined(marked, b" " + self.SEPARATOR + b" ")])
            cuts = (np.flatnonzero(ids == self.cut) * 4).tolist()
            raw = ids.astype("<u4").tobytes()
            found |= zip(marked, map(raw.__getitem__, map(slice, [0, *(c + 4 for c in cuts)], cuts)))
        for c in chunks:
            if self.SEPARATOR in c:
                found[c] = np.array(self._ids(c), dtype="<u4").tobytes()
        return list(map(found.__getitem__, chunks))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of ``text`` (null: empty) as uint32."""
        return self.encode_all([text])[0]

    def _look_up(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks, kept or new."""
        kept = self.kept
        missing = {c for c in chunks if c not in kept}
        if len(kept) + len(missing) > self.limit:
            kept.clear()
            missing = set(chunks)
        marked = [c for c in missing if c.endswith((b".", b",")) and c[-2:-1].isalpha()]
        stems = [c[:-1] for c in marked]
        whole = list(missing.difference(marked).union(set(stems).difference(kept), (b".", b",")))
        kept.update(zip(whole, self._encode(whole)))
        kept.update((c, kept[stem] + kept[c[-1:]]) for c, stem in zip(marked, stems))
        out = list(map(kept.__getitem__, chunks))
        for c in [c for c in missing if len(c) > 256]:
            kept.pop(c, None)
        return out

    def encode_all(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: empty). Arrow splits the texts and numbers their chunks; a gather puts the ids in place."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # names of special tokens keep their case
        split = pc.ascii_split_whitespace(lowered)
        numbered = split.flatten().dictionary_encode()
        found = self._look_up(numbered.dictionary.cast(pa.binary()).to_pylist())
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        chunk = numbered.indices.to_numpy(zero_copy_only=False)
        each = sizes[chunk]
        ends = np.cumsum(each)
        flat = ids[np.repeat((np.cumsum(sizes) - sizes)[chunk] - (ends - each), each) + np.arange(each.sum())]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def text_groups(texts: pa.Array | list[str], size: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about that many characters (bytes, of an Arrow array) together: a batch's pieces are never held at once."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(t or "") for t in texts]
    start, held = 0, 0
    for i, length in enumerate(lengths):
        held += length
        if held >= size:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(lengths):
        yield slice(start, len(lengths))


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def drop_tokenizers() -> None:
    """Forget this worker's tokenizers and what they keep."""
    _TOKENIZERS.clear()
    release_memory()


def word_tokenizer(path: str, limit: int = 900_000) -> WordTokenizer:
    """One tokenizer for each Python worker, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
    if (path, limit) not in _TOKENIZERS:
        _TOKENIZERS[path, limit] = WordTokenizer(path, limit)
    return _TOKENIZERS[path, limit]
