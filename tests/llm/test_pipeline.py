import public_tokenizers

import corpus_pipeline
from pulsegrid.llm.common import documents, materialise
from pulsegrid.llm.neardup import deduplicate
from tests.llm.fixtures import AWKWARD, awkward, empty
from tests.llm.test_neardup_threshold import brute
from tests.llm.test_packing import brute_pieces, check, rows


def test_stages_keep_whole_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, before = documents(spark, sf), dict(rows(spark, sf))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert kept[name].items() <= before.items()
        if name == "near_dedup":
            assert set(kept[name]) == {d for d, _, _, keep in brute(list(before.items()), 80) if keep}
        before = kept[name]
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(kept["quality"])) >= 0.99 * len(good & set(kept["language_id"]))
    assert len(bad & set(kept["quality"])) <= 0.1 * len(bad & set(kept["language_id"]))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted((tuple(r)[:5] for r in packed), key=str) == brute_pieces(before.items())
    check(packed)


def test_deduplicate_awkward(spark):
    docs = awkward(spark)
    found = deduplicate(docs)
    assert found.columns == docs.columns
    ids = sorted((r.doc_id for r in found.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 6, 7, 8, 9, None, -7], key=str)
    assert deduplicate(empty(spark)).collect() == []


def test_stages_take_awkward_tables(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).collect()
