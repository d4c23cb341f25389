import zlib

import numpy as np

from pulsegrid.llm import quality
from tests.llm.fixtures import awkward, empty


def test_whole_table_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in quality.op3_quality(spark, sf).collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(found) == sorted(docs)
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and found[d].predicted == int(found[d].score >= 0.3) and 0 <= found[d].score <= 1 for d in docs)
    held = [(found[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r.doc_id].held_out]
    good, bad = np.array([s for s, q in held if q == 1]), np.array([s for s, q in held if q == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_exact_neighbours_in_blocks(spark):
    """Small blocks give the same scores as one product over all references."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdef !"), 60)) for _ in range(40)]
    model = quality.NeighbourModel(np.ones(2**quality.BITS, np.float32), rng.normal(size=(quality.FEATURES, 8)).astype(np.float32), 0.7, neighbours=5, block=7)
    vectors, labels = model.latent(texts), rng.integers(0, 2, 40)
    model.fit(vectors, labels)
    probe = texts[:10] + ["new text", ""]
    found = model.score(probe)
    mine = model.latent(probe)
    for v, s in zip(mine[:-1], found):
        cosine = vectors @ v
        top = np.argsort(-cosine)[:5]
        weight = np.clip(cosine[top], 0, 1).astype(float) ** model.power * model.votes[top]
        assert abs(s - (weight * labels[top]).sum() / weight.sum()) < 1e-5


def test_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (8, 0), (9, None), (9, 1), (999, 1)], "doc_id long, quality int")
    docs = awkward(spark)
    found = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.quality_score <= 1 for r in found)
    assert [r.quality_score for r in found if r.text is None] == [r.quality_score for r in found if r.text == ""]
    none = quality.train(empty(spark), labels.where("false"))
    assert {r.quality_score for r in quality.score_documents(docs, none).collect()} == {1.0}
    assert quality.score_documents(empty(spark), none).collect() == []
