"""Hashed character n-grams with TF-IDF weights, shared by the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import column, release_memory

# Fixed odd multipliers of the n-gram hash, one for each place.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def ngram_hashes(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """One hash of ``bits`` bits for each n-gram of the text's code points, for each order."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in orders:
            if len(points) >= n:
                x = np.full(len(points) - n + 1, np.uint64(n) * PLACES[1])
                for k in range(n):
                    x += (points[k : len(points) - n + 1 + k] + np.uint64(1)) * PLACES[k]
                x ^= x >> np.uint64(29)
                x *= PLACES[3]
                out.append((x >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def counted_ngrams(text: str, orders: tuple[int, ...], bits: int, part: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram features of the whole text and their counts; of a long text, so many code points at a time."""
    if len(text) <= part:
        return counted(ngram_hashes(text, orders, bits), bits)
    total = np.zeros(2**bits, np.int64)
    for n in orders:
        for start in range(0, len(text), part):  # parts of one order overlap by n - 1 code points
            total += np.bincount(ngram_hashes(text[start : start + part + n - 1], (n,), bits), minlength=2**bits)
    found = np.flatnonzero(total)
    return found, total[found]


def counted(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their counts."""
    if len(hashes) < 3000:
        return np.unique(hashes, return_counts=True)
    counts = np.bincount(hashes, minlength=2**bits)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their TF-IDF weights at length 1; logarithmic term frequency."""
    index, counts = found
    values = (1 + np.log(counts)).astype(np.float32) * idf[index]
    length = np.sqrt((values * values).sum())
    return index, values / length if length else values


def document_frequencies(docs: DataFrame, features: Callable[[str], np.ndarray], bits: int) -> tuple[np.ndarray, int]:
    """In how many of ``docs`` (column text) each feature occurs, and their number.

    A task sums over all its texts and sends at most one row a feature; Spark adds those up. The driver gets 2**bits rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(2**bits, np.int64), 0
        for batch in batches:
            for text in column(batch, "text"):
                total[features(text or "")] += 1
                rows += 1
        found = np.flatnonzero(total)
        release_memory()
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(found, -1), pa.int32()), "n": pa.array(np.append(total[found], rows), pa.int64())})

    sums = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, rows = np.zeros(2**bits, np.int64), 0
    for feature, n in sums:
        if feature < 0:
            rows = n
        else:
            df[feature] = n
    return df, rows


def inverse(df: np.ndarray, rows: int) -> np.ndarray:
    return (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)
