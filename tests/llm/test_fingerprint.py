import hashlib
import unicodedata

import xxhash

from pulsegrid.llm.fingerprint import collided, edited_text, fingerprints, op10_fingerprints
from tests.llm.fixtures import AWKWARD, awkward, empty, rows


def plain(text):
    form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(form.split()).encode()


def brute(pairs):
    docs = sorted(((d, t or "") for d, t in pairs), key=lambda p: (p[0] is None, -(p[0] or 0), p[1]))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        a, b, c = plain(text), plain(edited), plain(following)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), xxhash.xxh3_128_hexdigest(a), xxhash.xxh3_128_hexdigest(b), float(a == b), float(a == c)))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    assert sorted((tuple(r) for r in op10_fingerprints(spark, sf_dir).collect()), key=str) == brute(rows(spark, sf_dir))


def test_awkward(spark):
    found = fingerprints(awkward(spark)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute([(d, t) for d, t, _, _ in AWKWARD])
    assert fingerprints(empty(spark)).collect() == []
    assert [r.near_next for r in fingerprints(awkward(spark).limit(1)).collect()] == [1.0]


def test_colliding_digests_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert collided(docs).isEmpty()
    found = fingerprints(docs, bits=4).collect()  # 16 digests only
    by = {}
    for doc_id, text in rows(spark, sf_dir):
        by[doc_id] = plain(text)
    print_of = {r.doc_id: r.fingerprint for r in found}
    assert len(set(print_of.values())) == len(set(by.values()))
    assert len({(print_of[d], by[d]) for d in by}) == len(set(by.values()))


def test_edit():
    assert edited_text("abcdefg", "XY") == "abcdeXY"
    assert edited_text("ab", "XY") == "ab"
