import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm.media import KEY_EVERY, PACKET, _box, _full, describe_media, media_digests, op4_iso_media, store_texts, stored_bytes, tracks, walk, wrap_payload
from tests.llm.fixtures import AWKWARD, awkward, empty, rows


def brute(pairs):
    out = []
    for doc_id, text in pairs:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        out.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    found = op4_iso_media(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute(rows(spark, sf_dir))
    assert all(json.loads(r.feature)["codec"] == "ipcm" and json.loads(r.feature)["duration"] == r.payload_bytes for r in found)


def test_awkward(spark):
    found = media_digests(store_texts(awkward(spark))).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute([(d, t) for d, t, _, _ in AWKWARD])
    by_text = {}
    for r in found:
        assert by_text.setdefault(r.payload_sha256, tuple(r)[1:]) == tuple(r)[1:]
    assert media_digests(store_texts(empty(spark))).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 255))
def test_round_trip(packets, byte):
    payload = bytes((byte + i) % 256 for i in range(packets * PACKET))
    data = wrap_payload(payload)
    (track,) = tracks(data)
    assert stored_bytes(data, track) == payload
    assert (track.codec, track.timescale, track.duration) == ("ipcm", 8000, len(payload))
    assert track.keys.tolist() == list(range(0, packets, KEY_EVERY))
    assert all(data[track.offsets[k] : track.offsets[k] + PACKET] == payload[k * PACKET : (k + 1) * PACKET] for k in track.keys)


def movie(*tables, body=b""):
    head = _full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 90), bytes(4))
    return _box(b"moov", _box(b"trak", _box(b"mdia", head, _box(b"minf", _box(b"stbl", *tables))))) + body


def test_other_table_forms():
    """Sizes of their own, 64-bit offsets, two chunk runs, no sync table (every sample is a key), 4-bit sizes."""
    stsd = _full(b"stsd", struct.pack(">I", 1), _box(b"avc1", bytes(70)))
    stsz = _full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 6, 7))
    stsc = _full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1))
    (t,) = tracks(movie(stsd, stsz, stsc, _full(b"co64", struct.pack(">IQQ", 2, 100, 2**33))))
    assert (t.codec, t.timescale, t.duration) == ("avc1", 1000, 90)
    assert t.offsets.tolist() == [100, 105, 2**33] and t.sizes.tolist() == [5, 6, 7] and t.keys.tolist() == [0, 1, 2]
    (t,) = tracks(movie(stsd, _full(b"stz2", struct.pack(">BBBB", 0, 0, 0, 4), struct.pack(">I", 3), b"\x56\x70"), stsc, _full(b"stco", struct.pack(">III", 2, 9, 99))))
    assert t.sizes.tolist() == [5, 6, 7] and t.offsets.tolist() == [9, 14, 99]


def test_large_and_open_boxes():
    inner = _box(b"free", b"abc")
    large = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    assert [p for p, _, _ in walk(large + struct.pack(">I4s", 0, b"mdat") + b"rest")] == [(b"moov",), (b"moov", b"free"), (b"mdat",)]
    with pytest.raises(ValueError):
        list(walk(struct.pack(">I4s", 100, b"moov")))


def test_describe(spark):
    good = wrap_payload(bytes(64 * 20))
    df = spark.createDataFrame([(1, good), (2, good[:300]), (3, b"no media"), (4, None), (5, b"")], "doc_id long, media binary")
    found = {r.doc_id: r for r in describe_media(df).collect()}
    assert (found[1].codec, found[1].n_samples, found[1].key_lengths, found[1].error) == ("ipcm", 20, [64] * 3, None)
    assert found[2].error and found[3].error and found[5].error
    assert found[4].error is None and found[4].codec is None
    assert np.array(found[1].key_offsets).tolist() == [len(good) - 64 * 20 + 64 * k for k in (0, 8, 16)]


@pytest.mark.parametrize("bad", ["samples", "nested", "key", "outside", "fragments"])
def test_bad_files_give_an_error(spark, bad):
    good, box = wrap_payload(bytes(64 * 40)), lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    if bad == "samples":
        at = good.index(b"stsz") + 8
        data = good[:at] + struct.pack(">II", 8, 2**32 - 1) + good[at + 8 :]
    elif bad == "nested":
        data = b""
        for _ in range(1500):
            data = box(b"moov", data)
    elif bad == "key":
        at = good.index(b"stss") + 12
        data = good[:at] + struct.pack(">I", 0) + good[at + 4 :]
    elif bad == "outside":
        at = good.index(b"stco") + 12
        data = good[:at] + struct.pack(">I", 2**31) + good[at + 4 :]
    else:
        data = good + box(b"moof", b"")
    row = describe_media(spark.createDataFrame([(1, bytearray(data))], "id int, media binary")).first()
    assert row.error and row.codec is None
