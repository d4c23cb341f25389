"""Operator 8: byte-level BPE with a two-tier lookup.

A pre-token that is itself a vocabulary entry is resolved by a minimal perfect hash over the vocabulary, for all new
pre-tokens of a batch at once. The others are merged by a heap over a doubly linked list of bytes: the pair of least rank,
and of these the leftmost, is merged first, in O(n log n) for a pre-token of n bytes.

Cases: a null text counts as empty and gives no ids (the digests are then those of the empty string); very long
pre-tokens are merged by the same heap; repeated rows give equal results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import column, documents, text_groups

_LEVEL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash for each level, from the key's one hash."""
    with np.errstate(over="ignore"):
        x = hashes + _LEVEL * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct 64-bit key hashes to its own number in 0..n-1.

    On each level the keys left over are thrown into twice as many cells; a key alone in its cell is settled there, the
    others go on. A key's number is the rank of its cell among all settled cells.
    """

    def __init__(self, hashes: np.ndarray):
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("key hashes must be distinct")
        self.levels, left, before = [], np.asarray(hashes, dtype=np.uint64), 0
        while len(left):
            size = max(2 * len(left), 64)
            cells = (_mixed(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cells, minlength=size) == 1
            self.levels.append((size, alone, before + np.cumsum(alone) - 1))
            settled = alone[cells]
            before, left = before + int(settled.sum()), left[~settled]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the keys; a key that is not in the set gets some number or -1, so the caller compares the key."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        for level, (size, alone, rank) in enumerate(self.levels):
            cells = (_mixed(hashes[open_], level) % np.uint64(size)).astype(np.int64)
            hit = alone[cells]
            out[open_[hit]] = rank[cells[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE ids of one pre-token by a heap of candidate pairs over linked bytes."""
    n, get = len(piece), ranks.get
    heap = [rank << 40 | i for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]  # the rank, then the place
    if not heap:
        return [ranks[piece[i : i + 1]] for i in range(n)]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    end = list(range(1, n + 2))  # a live node at i covers piece[i:end[i]]; -1 marks a node that was merged away
    back = list(range(-1, n))
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFFFF
        middle = end[i]
        if middle < 0 or middle >= n:
            continue
        stop = end[middle]
        if get(piece[i:stop]) != top >> 40:
            continue  # the pair that stood here has changed meanwhile
        end[middle] = -1
        end[i] = stop
        back[stop] = i
        if stop < n and (rank := get(piece[i : end[stop]])) is not None:
            push(heap, rank << 40 | i)
        if (left := back[i]) >= 0 and (rank := get(piece[left:stop])) is not None:
            push(heap, rank << 40 | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBPE:
    """Encoder and decoder for a rank file; keeps found pre-tokens, emptied at ``limit`` entries, which changes no result."""

    def __init__(self, rank_lines: bytes, pattern: str, limit: int = 1_000_000):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        self.token = {rank: token for token, rank in self.ranks.items()}
        keys = list(self.ranks)
        self.hash = PerfectHash(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64))
        self.slots: list[bytes] = [b""] * len(keys)
        for number, key in zip(self.hash(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)), keys):
            self.slots[number] = key
        # white space as Unicode defines it, without the four separators that Python's regex adds
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.limit, self.kept = limit, {}

    def _resolve(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """For new pre-tokens: ids as bytes, and ids in decimal."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        numbers = self.hash(np.array([xxhash.xxh3_64_intdigest(r) for r in raw], dtype=np.uint64))
        found = {}
        for piece, key, number in zip(pieces, raw, numbers):
            whole = number >= 0 and self.slots[number] == key
            ids = [self.ranks[key]] if whole else merge_bytes(key, self.ranks)
            found[piece] = np.array(ids, dtype="<u4").tobytes(), b" ".join(b"%d" % i for i in ids)
        return found

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """For each text its ids, and its ids in decimal joined by one space."""
        split = [self.find(text) for text in texts]
        new = [p for p in set().union(*split) if p not in self.kept]
        if len(self.kept) + len(new) > self.limit:
            self.kept.clear()
            new = list(set().union(*split))
        self.kept.update(self._resolve(new))
        out = []
        for pieces in split:
            entries = list(map(self.kept.__getitem__, pieces))
            out.append((np.frombuffer(b"".join([e[0] for e in entries]), dtype="<u4"), b" ".join([e[1] for e in entries])))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_ENCODERS: dict[tuple[str, str], ByteBPE] = {}


def encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder for each Python worker."""
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as lines:
            _ENCODERS[path, pattern] = ByteBPE(lines.read(), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Map-only: ids (if asked for), their number and digest, and the digest of the bytes that the ids decode to."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            out = {"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
            texts = [t or "" for t in column(batch, "text")]
            for group in text_groups(texts):
                for ids, decimal in bpe.encode_batch(texts[group]):
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(decimal).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        out["ids"].append(ids.astype(np.int32))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
