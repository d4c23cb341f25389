import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm.common import WordTokenizer, shared_path
from pulsegrid.llm.token_store import EliasFano, Segment, op1_token_store, pack_segment, read_store, write_store
from tests.llm.fixtures import AWKWARD, awkward, empty, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(pairs):
    model, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def order(found):
    return sorted(found, key=lambda r: r[1])


def test_whole_table(spark, sf_dir):
    assert order(tuple(r) for r in op1_token_store(spark, sf_dir).collect()) == brute(rows(spark, sf_dir))


def test_awkward_and_small_segments(spark):
    path = shared_path(spark, "t")
    write_store(awkward(spark), path, PATH, 2, segment_ids=50)
    assert order(tuple(r) for r in read_store(spark, path).collect()) == brute([(d, t) for d, t, _, _ in AWKWARD])


def test_empty(spark):
    path = shared_path(spark, "t")
    write_store(empty(spark), path, PATH, 2)
    assert read_store(spark, path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(gaps):
    values = np.cumsum(np.array(gaps, dtype=np.uint64)) if gaps else np.array([], dtype=np.uint64)
    held = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    assert held.values().tolist() == values.tolist()
    assert [held[i] for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(EliasFano.build(values).to_bytes()) < 10_000 * 2  # 64-bit offsets would take 80 000


def test_ids_that_do_not_fit_are_an_error():
    with pytest.raises(ValueError):
        pack_segment([1], [np.array([70_000], "<u4")], 2)
    assert Segment(pack_segment([1], [np.array([70_000], "<u4")], 4)).document(0).tolist() == [70_000]


def test_width_follows_the_end_id(spark):
    path = shared_path(spark, "t")
    write_store(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path, PATH, 70_000)
    segment = Segment(bytes(spark.read.parquet(path).first().segment))
    assert segment.id_bytes == 4 and segment.document(0)[-1] == 70_000


def test_segment_random_access():
    ids = [np.arange(n, dtype="<u4") for n in (3, 1, 500, 2)]
    segment = Segment(pack_segment([None, -5, 7, 7], ids, 2))
    assert segment.doc_ids() == [None, -5, 7, 7]
    assert all(segment.document(i).tolist() == x.tolist() for i, x in enumerate(ids))


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_chunks_equal_whole_text(text):
    expected = MODEL.model.encode(text, add_special_tokens=False).ids
    assert MODEL.encode(text).tolist() == expected


AWKWARD_TEXT = st.text(alphabet="ab'sé.,\x01\x1c\x0b\x0c\xa0\u0301 <|>\n\tÀZQ0", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(AWKWARD_TEXT | st.sampled_from(["<|endoftext|>", "X<|STARTOFTEXT|>Y.", "it's. The,"]), max_size=5))
def test_batches_of_awkward_texts(texts):
    assert [ids.tolist() for ids in MODEL.encode_all(texts)] == [MODEL.model.encode(t, add_special_tokens=False).ids for t in texts]


MODEL = WordTokenizer(PATH, limit=50)
