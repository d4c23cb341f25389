"""Operator 6: packing documents into sequences of at most 4096 tokens by a grouping genetic algorithm.

Documents longer than a sequence are cut into full pieces and a rest; full pieces are sequences already. The other pieces
are dealt by a hash to blocks of about ``block_pieces``, each an instance of bin packing. Every block is evolved on several
islands: a Spark row is one island with its population, an epoch is one pass over these rows, and between epochs each
island's best packing migrates to the next island of its block through a join, where it takes the place of the worst.

A population starts from packings that fill one bin after the other in random orders, so that evolution has to find the
packing. Every island breeds its full number of children in every epoch, also when no fewer bins are possible; then the
fill decides. Crossover injects whole well-filled bins of one parent into the other, removes the bins that would hold a
piece twice, and puts displaced pieces back by best fit, longest first. Mutation dissolves the emptiest bins. Fitness is
fewer bins, then the mean of squared fill. Each piece carries its block's figures: bins of the best start and of the result,
children bred, children and guests accepted, over all its islands.

Cases: a null or empty text is one piece with the end id alone; repeated rows and doc_ids, and null doc_ids, are pieces
like others; a long text is encoded whole and cut after that; pieces of equal length are told apart by their order alone;
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import column, documents, drop_tokenizers, materialise, text_groups, word_tokenizer

CAPACITY = 4096


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_words: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, map-only. Without ``keep_words`` a task keeps fewer words and leaves none behind."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_tokenizer(tokenizer, 900_000 if keep_words else 150_000), np.array([end_id], dtype="<u4")
        for batch in batches:
            doc_ids, texts, out = column(batch, "doc_id"), batch.column(batch.schema.get_field_index("text")), []
            for group in text_groups(texts, 4_000_000 if keep_words else 1_000_000):
                for doc_id, found in zip(doc_ids[group], words.encode_all(texts[group])):
                    ids = np.concatenate([found, end])
                    out += [(doc_id, i, at, len(part := ids[at : at + capacity]), zlib.crc32(part)) for i, at in enumerate(range(0, len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)
        if not keep_words:
            drop_tokenizers()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, items: np.ndarray, room: list[int], capacity: int) -> np.ndarray:
    """The bin of each of ``items``, put one by one into the fullest bin that takes it; ``room`` of the bins grows in place.

    Bins stand under the room they have left; a bit for each room that some bin has finds the least that is enough.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for b, left in enumerate(room):
        if left:
            free[left].append(b)
            some |= 1 << left
    out = []
    for need in lengths[items].tolist():
        enough = some >> need
        if enough:
            left = need + (enough & -enough).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some ^= 1 << left
        else:
            left, b = capacity, len(room)
            room.append(capacity)
        out.append(b)
        room[b] = left = left - need
        if left:
            free[left].append(b)
            some |= 1 << left
    return np.array(out, np.int32)


class Island:
    """A population of packings of one block; a packing is the bin of each piece. Pieces come longest first."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: list[int]):
        self.lengths, self.capacity, self.rng = lengths, capacity, np.random.default_rng(seed)
        self.least = -(-int(lengths.sum()) // capacity)
        self.bred = self.accepted = self.guests = 0

    def fitness(self, packing: np.ndarray) -> tuple[int, float]:
        fill = np.bincount(packing, self.lengths)
        return -len(fill), float(np.mean((fill / self.capacity) ** 2))

    def start(self, size: int) -> list[np.ndarray]:
        """Packings that take the pieces in random orders and open a bin whenever the last one is full."""
        out = []
        for _ in range(size):
            order, packing, b, room = self.rng.permutation(len(self.lengths)), np.empty(len(self.lengths), np.int32), 0, self.capacity
            for i, need in zip(order.tolist(), self.lengths[order].tolist()):
                if need > room:
                    b, room = b + 1, self.capacity
                packing[i] = b
                room -= need
            out.append(packing)
        return out

    def _refill(self, kept: np.ndarray) -> np.ndarray:
        """``kept`` holds bin numbers, -1 for displaced pieces; these are put back by best fit."""
        placed, displaced = np.flatnonzero(kept >= 0), np.flatnonzero(kept < 0)
        numbers, packed = np.unique(kept[placed], return_inverse=True)
        room = (self.capacity - np.bincount(packed, self.lengths[placed], minlength=len(numbers))).astype(int).tolist()
        out = np.empty(len(kept), np.int32)
        out[placed] = packed
        out[displaced] = best_fit(self.lengths, displaced, room, self.capacity)
        return out

    def cross(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        """Half of the father's well-filled bins (at least 98 percent, or as full as its middle bin) go into the mother whole."""
        fill = np.bincount(father, self.lengths)
        full = np.flatnonzero(fill >= min(0.98 * self.capacity, np.median(fill)))
        chosen = full[self.rng.random(len(full)) < 0.5]
        injected = np.isin(father, chosen)
        hurt = np.isin(mother, np.unique(mother[injected]))
        kept = np.where(injected, father + mother.max() + 1, np.where(hurt, -1, mother))
        return self._refill(kept)

    def mutate(self, packing: np.ndarray, share: float = 0.05) -> np.ndarray:
        fill = np.bincount(packing, self.lengths)
        emptiest = np.argsort(fill + self.rng.random(len(fill)) * 0.1 * self.capacity)[: max(1, int(share * len(fill)))]
        return self._refill(np.where(np.isin(packing, emptiest), -1, packing))

    def _join(self, population: list[np.ndarray], packing: np.ndarray) -> tuple[list[np.ndarray], bool]:
        """The population, best first, in which ``packing`` stands for the worst if it is better than that."""
        if self.fitness(packing) <= self.fitness(population[-1]):
            return population, False
        return sorted([*population[:-1], packing], key=self.fitness, reverse=True), True

    def welcome(self, population: list[np.ndarray], guest: np.ndarray) -> list[np.ndarray]:
        population, joined = self._join(population, guest)
        self.guests += joined
        return population

    def evolve(self, population: list[np.ndarray], children: int) -> list[np.ndarray]:
        """So many children of two parents each; sorted, best first."""
        population = sorted(population, key=self.fitness, reverse=True)
        for _ in range(children):
            mother, father = (population[i] for i in self.rng.choice(len(population), 2, replace=len(population) < 2))
            population, joined = self._join(population, self.mutate(self.cross(mother, father)))
            self.bred += 1
            self.accepted += joined
        return population


COUNTS = ("start_bins", "bred", "accepted", "guests")
STATE = "block long, island int, bins int, fill double, start_bins long, bred long, accepted long, guests long, ids binary, lengths binary, population array<binary>"
#: The figures of a block that its pieces carry.
FIGURES = ("block", "start_bins", "bins", "bred", "accepted", "guests")


def _state(block: int, island: int, world: Island, counts: tuple, ids: np.ndarray, population: list[np.ndarray]) -> pd.DataFrame:
    bins, fill = world.fitness(population[0])
    return pd.DataFrame([(block, island, -bins, fill, *counts, ids.tobytes(), world.lengths.astype("<i4").tobytes(), [p.astype("<i4").tobytes() for p in population])], columns=[c.split()[0] for c in STATE.split(", ")])


def evolve_blocks(items: DataFrame, capacity: int = CAPACITY, islands: int = 2, population: int = 4, epochs: int = 2, children: int = 16) -> DataFrame:
    """(item, sequence, offset) and the FIGURES of the block, for rows (block, item, length) with 0 < length < capacity."""

    def found(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "item"], ascending=[False, True])
        world = Island(frame.length.to_numpy().astype(np.int64), capacity, [int(key[0]), int(key[1]), 0])
        first = sorted(world.start(population), key=world.fitness, reverse=True)
        return _state(int(key[0]), int(key[1]), world, (-world.fitness(first[0])[0], 0, 0, 0), frame.item.to_numpy().astype("<i8"), first)

    def epoch(number: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    world = Island(np.frombuffer(r.lengths, "<i4").astype(np.int64), capacity, [r.block, r.island, number])
                    members = world.evolve([np.frombuffer(p, "<i4") for p in r.population], children)
                    if r.guest is not None:
                        members = world.evolve(world.welcome(members, np.frombuffer(r.guest, "<i4")), children)
                    yield _state(r.block, r.island, world, (r.start_bins, r.bred + world.bred, r.accepted + world.accepted, r.guests + world.guests), np.frombuffer(r.ids, "<i8"), members)

        return run

    state = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).groupBy("block", "island").applyInPandas(found, STATE)
    state = materialise(state, "islands")
    for number in range(1, epochs + 1):
        guests = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.element_at("population", 1).alias("guest"))
        state = materialise(state.join(guests, ["block", "island"]).mapInPandas(epoch(number), STATE), "islands")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, packing, *figures in zip(*(column(batch, c) for c in ("ids", "lengths", "best", *FIGURES))):
                ids, lengths, packing = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i4").astype(np.int64), np.frombuffer(packing, "<i4")
                order = np.argsort(packing, kind="stable")
                ends = np.cumsum(lengths[order])
                starts = ends - lengths[order]
                first = np.searchsorted(packing[order], packing[order], side="left")
                out = {"item": pa.array(ids[order], pa.int64()), "sequence": pa.array(packing[order].astype(np.int64) + figures[0] * 2**24, pa.int64()), "offset": pa.array(starts - starts[first], pa.int64())}
                yield pa.RecordBatch.from_pydict(out | {c: pa.array(np.full(len(ids), x, np.int64)) for c, x in zip(FIGURES, figures)})

    best = state.groupBy("block").agg(F.min(F.struct("bins", -F.col("fill"), "island"))["island"].alias("island"), F.min("start_bins").alias("start_bins"), *(F.sum(c).alias(c) for c in COUNTS[1:]))
    chosen = state.drop(*COUNTS).join(best, ["block", "island"]).select("ids", "lengths", F.element_at("population", 1).alias("best"), *FIGURES)
    return chosen.mapInArrow(unpack, "item long, sequence long, offset long, " + ", ".join(f"{c} long" for c in FIGURES))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, block_pieces: int = 10_000, keep_words: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its block's figures (null for full pieces)."""
    pieces = materialise(pieces_of(docs, tokenizer, end_id, capacity, keep_words).withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // block_pieces))
    items = short.select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", "length")
    packed = short.join(evolve_blocks(items, capacity), "item").withColumnRenamed("sequence", "sequence_id")
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")} | {c: F.lit(None).cast("long") for c in FIGURES})
    return packed.unionByName(full).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *FIGURES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
