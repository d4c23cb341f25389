import zlib

import numpy as np
import pytest

from pulsegrid.llm import langid
from tests.llm.fixtures import awkward, empty


def test_whole_table_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in langid.op2_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(found) == {d.doc_id for d in docs}
    assert all(found[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    held = [d for d in docs if found[d.doc_id].held_out]
    assert np.mean([found[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())


def test_awkward(spark):
    model = langid.train(awkward(spark))
    assert set(model.languages) == {"en", "fr"}
    found = langid.predict(awkward(spark), model).collect()
    assert {r.text for r in found if r.lang_pred == "und"} == {None, "", "  \t\n ", "*** $$$ !!! ###"}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in found)
    nothing = langid.train(empty(spark))
    assert langid.predict(empty(spark), model).collect() == []
    assert {r.lang_pred for r in langid.predict(awkward(spark), nothing).collect()} == {"und"}


def test_lang_and_source_are_no_inputs(spark):
    model = langid.train(awkward(spark))
    swapped = awkward(spark).selectExpr("doc_id + 5 AS doc_id", "text", "'zz' AS lang", "'zz' AS source")
    first = {r.text: r.lang_pred for r in langid.predict(awkward(spark), model).collect()}
    assert {r.text: r.lang_pred for r in langid.predict(swapped, model).collect()} == first


def test_penalty_keeps_weights_sparse():
    rng, model = np.random.default_rng(0), langid.FTRL(1000, 2, l1=0.5)
    for _ in range(400):
        label = int(rng.integers(2))
        index = np.unique(np.append(rng.integers(2, 1000, 20), label))
        model.learn(index, np.full(len(index), 0.2, np.float32), label)
    weights = model.weights(slice(None))
    assert np.mean(weights[2:] == 0) > 0.9
    assert weights[0, 0] > weights[0, 1] and weights[1, 1] > weights[1, 0]


def test_temperature_recovers_the_scale():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert langid.temperature(logits * 3, labels) == pytest.approx(3, rel=0.15)
