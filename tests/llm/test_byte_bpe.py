import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm.byte_bpe import PerfectHash, encode_documents, encoder, merge_bytes, op8_byte_bpe
from tests.llm.fixtures import AWKWARD, awkward, empty, rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(pairs):
    out = []
    for doc_id, text in pairs:
        ids = ORACLE.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    assert sorted((tuple(r) for r in op8_byte_bpe(spark, sf_dir).collect()), key=str) == brute(rows(spark, sf_dir))


def test_awkward(spark):
    found = encode_documents(awkward(spark), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute([(d, t) for d, t, _, _ in AWKWARD])
    assert encode_documents(empty(spark), PATH, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    ids, decimal = encoder(PATH, public_tokenizers.PATTERN).encode(text)
    assert ids.tolist() == ORACLE.encode_ordinary(text)
    assert decimal == " ".join(map(str, ids)).encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinrst", min_size=1, max_size=60))
def test_heap_merges(word):
    assert merge_bytes(word.encode(), RANKS) == ORACLE.encode_ordinary(word)


def test_perfect_hash_is_minimal():
    hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in RANKS], dtype=np.uint64)
    assert sorted(PerfectHash(hashes)(hashes)) == list(range(len(hashes)))
