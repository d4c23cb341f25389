import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pulsegrid.llm.packing import CAPACITY, Island, best_fit, op6_packing, pack_documents
from tests.llm.fixtures import AWKWARD, awkward, empty, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(pairs, capacity=CAPACITY):
    model, out = Tokenizer.from_file(PATH), []
    for doc_id, text in pairs:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        out += [(doc_id, i, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity])) for i, at in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


def check(found, capacity=CAPACITY):
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    found = op6_packing(spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_pieces(rows(spark, sf))
    assert check(found) <= 1.01 * -(-sum(r.length for r in found) // CAPACITY) + 1
    blocks = {tuple(r)[7:] for r in found if r.block is not None}
    assert blocks
    for _, start_bins, bins, bred, accepted, guests in blocks:  # evolution makes the packing: it betters its own start by far
        assert bins < 0.95 * start_bins and bred == 2 * 2 * 2 * 16 and accepted > 0 and guests > 0
    assert sum(r[2] for r in blocks) == check([r for r in found if r.block is not None])


def test_awkward_in_small_blocks(spark):
    found = pack_documents(awkward(spark), PATH, 1, capacity=64, block_pieces=3).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_pieces([(d, t) for d, t, _, _ in AWKWARD], 64)
    check(found, 64)
    assert pack_documents(empty(spark), PATH, 1).collect() == []


def test_best_fit_takes_the_fullest_bin_that_has_room():
    rng = np.random.default_rng(2)
    lengths, room = rng.integers(1, 60, 300), [40, 7, 100]
    plain, expected = list(room), []
    for need in lengths.tolist():
        fits = [left for left in plain if left >= need]
        if not fits:
            plain.append(100)
        expected.append(min(fits, default=100))
        plain[plain.index(expected[-1])] -= need
    left = list(room)
    bins = best_fit(lengths, np.arange(300), left, 100)
    assert sorted(left) == sorted(plain)
    held = [40, 7, 100] + [100] * (len(left) - 3)
    for b, need, was in zip(bins.tolist(), lengths.tolist(), expected):
        assert held[b] == was
        held[b] -= need


def test_evolution_betters_best_fit():
    """Triplets that fill a bin exactly are hard for best fit; evolution must not lose and must keep packings sound."""
    rng = np.random.default_rng(3)
    parts = []
    for _ in range(40):
        a, b = rng.integers(250, 350), rng.integers(250, 350)
        parts += [a, b, 1000 - a - b]
    lengths = np.sort(np.array(parts))[::-1]
    world = Island(lengths, 1000, [1])
    first = world.start(4)
    last = world.evolve(first, 400)
    assert world.least == 40
    assert world.fitness(last[0]) > max(map(world.fitness, first))
    assert all(np.bincount(p, lengths).max() <= 1000 for p in last)
