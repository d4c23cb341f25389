"""Operator 4: ISO base media files as columns.

describe_media() walks the nested boxes of a file and decodes its sample tables (stsd, mdhd, stts, stsz or stz2, stsc, stco
or co64, stss) into codec, timescale, duration and the byte ranges of the key frames. It never decodes a payload; sample
bytes are found by offset alone.

wrap_payload() stores any bytes losslessly as one track of 8-bit integer PCM (sample entry ``ipcm``): a media sample is a
packet of 64 bytes, a chunk holds 16 packets, and every 8th packet is a key frame. It writes no times of day, so equal
payloads give equal files.

Cases: a null or empty text is 64 bytes of zero; a long text is stored whole; repeated rows give equal files; files that are
not ISO media, or are cut short, give no tracks and a non-null ``error``, and so do tables that disagree, name more samples
than the file can hold, or bytes outside it, and samples in movie fragments; of a file with several tracks the first is
described; null media give nulls; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import column, documents, materialise

# Fixed values of the format: boxes that hold only boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}
#: Boxes below this depth are walked, but under their ancestor's path: none of the tables lies so deep.
DEEPEST = 16
PACKET, PACKETS_IN_CHUNK, KEY_EVERY, RATE = 64, 16, 8, 8000
# Fixed values of the format: the identity transformation of a track header.
IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) + 8 < 2**32 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *content)


def wrap_payload(payload: bytes) -> bytes:
    """A file whose one track holds ``payload``, a multiple of 64 bytes."""
    n = len(payload) // PACKET
    chunks, last = -(-n // PACKETS_IN_CHUNK), n % PACKETS_IN_CHUNK or PACKETS_IN_CHUNK
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    runs = [(1, PACKETS_IN_CHUNK, 1)] if last == PACKETS_IN_CHUNK else [(1, PACKETS_IN_CHUNK, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    wide = len(payload) + 2**16 + 16 * chunks + len(keys) * 4 >= 2**32
    duration = n * PACKET

    def movie(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.int64) * PACKET * PACKETS_IN_CHUNK).astype(">u8" if wide else ">u4").tobytes()
        entry = _box(b"ipcm", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16), _full(b"pcmC", b"\x01\x08"))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, PACKET)),
            _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", PACKET, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), IDENTITY, bytes(8), version=1, flags=3)
        header = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), IDENTITY, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", header, _box(b"trak", track, media))

    first = len(head) + len(movie(0)) + (8 if len(payload) + 8 < 2**32 else 16)
    return head + movie(first) + _box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of the content, end) of every box, depth first; ValueError where a box leaves its parent."""
    open_ = [(0, len(data), ())]  # where to go on, its parent's end and path; however deep boxes are nested
    while open_:
        start, end, path = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        inner = (*path, kind) if len(path) < DEEPEST else path
        yield inner, body, start + size
        open_.append((start + size, end, path))
        if kind in CONTAINERS:
            open_.append((body, start + size, inner))


@dataclass
class Track:
    codec: str | None = None
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _entries(data: bytes, at: int, end: int, kind: str, columns: int, skip: int = 4) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + skip)[0]
    if at + skip + 4 + n * columns * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table is cut short")
    return np.frombuffer(data, kind, n * columns, at + skip + 4).astype(np.int64).reshape(n, columns)


def tracks(data: bytes) -> list[Track]:
    """Sample tables of each track, as sizes, offsets and 0-based key frame numbers."""
    found, tables = [], []
    for path, at, end in walk(data):
        kind = path[-1]
        if path == (b"moof",):
            raise ValueError("samples in movie fragments are not read")
        if kind == b"trak":
            found.append(Track())
            tables.append({})
        elif path[:2] == (b"moov", b"trak") and found:
            track, table = found[-1], tables[-1]
            if kind == b"mdhd":
                version = data[at]
                track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if version == 1 else struct.unpack_from(">II", data, at + 12)
            elif kind == b"stsd":
                if at + 16 > end:
                    raise ValueError("a sample description is cut short")
                track.codec = data[at + 12 : at + 16].decode("latin-1")
            elif kind == b"stts":
                table["stts"] = _entries(data, at, end, ">u4", 2)
            elif kind == b"stsc":
                table["stsc"] = _entries(data, at, end, ">u4", 3)
            elif kind in (b"stco", b"co64"):
                table["chunks"] = _entries(data, at, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
            elif kind == b"stss":
                table["stss"] = _entries(data, at, end, ">u4", 1)[:, 0] - 1
            elif kind == b"stsz":
                size, n = struct.unpack_from(">II", data, at + 4)
                if size * n > len(data):
                    raise ValueError("more samples than the file holds")
                table["sizes"] = np.full(n, size, np.int64) if size else _entries(data, at, end, ">u4", 1, 8)[:, 0]
            elif kind == b"stz2":
                bits, n = struct.unpack_from(">B", data, at + 7)[0], struct.unpack_from(">I", data, at + 8)[0]
                raw = np.frombuffer(data, np.uint8 if bits <= 8 else ">u2", -(-n * bits // (8 if bits <= 8 else 16)), at + 12)
                table["sizes"] = (np.column_stack([raw >> 4, raw & 15]).ravel()[:n] if bits == 4 else raw).astype(np.int64)
    for track, table in zip(found, tables):
        sizes, chunks, runs = table.get("sizes", track.sizes), table.get("chunks", track.offsets), table.get("stsc", np.zeros((0, 3), np.int64))
        if len(sizes) and len(chunks) and len(runs):
            in_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
            if len(in_chunk) != len(chunks) or in_chunk.sum() != len(sizes) or (in_chunk < 1).any():
                raise ValueError("chunks and sizes disagree")
            chunk_of = np.repeat(np.arange(len(chunks)), in_chunk)
            ends = np.cumsum(sizes)
            first = np.concatenate([[0], np.cumsum(in_chunk)[:-1]])
            track.offsets = chunks[chunk_of] + (ends - sizes) - (ends - sizes)[first][chunk_of]
        track.sizes, track.keys = sizes, table.get("stss", np.arange(len(sizes)))
        if "stts" in table and not track.duration:
            track.duration = int((table["stts"][:, 0] * table["stts"][:, 1]).sum())
    return found


def check_ranges(track: Track, length: int) -> None:
    """ValueError unless every sample lies in a file of ``length`` bytes and every key frame is a sample."""
    if len(track.offsets) != len(track.sizes):
        raise ValueError("sizes without chunks")
    if (track.offsets < 0).any() or (track.offsets + track.sizes > length).any():
        raise ValueError("a sample lies outside the file")
    if len(track.keys) and not 0 <= track.keys.min() <= track.keys.max() < len(track.sizes):
        raise ValueError("a key frame is not a sample")


def stored_bytes(data: bytes, track: Track) -> bytes:
    """The track's sample bytes in order, joined where they lie side by side."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.append(breaks - 1, len(ends) - 1)
    return b"".join(data[track.offsets[a] : ends[b]] for a, b in zip(firsts, lasts))


MEDIA = "codec string, timescale long, duration long, n_samples long, key_offsets array<long>, key_lengths array<long>, error string"


def describe_media(df: DataFrame, media: str = "media", keys: list[str] | None = None) -> DataFrame:
    """Key columns and, of the first track: codec, timescale, duration, samples, and byte ranges of the key frames."""
    keys = keys or [c for c in df.columns if c != media]
    schema = df.select(*keys).schema

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: batch.column(batch.schema.get_field_index(k)) for k in keys} | {n.split()[0]: [] for n in MEDIA.split(", ")}
            for data in column(batch, media):
                row = dict.fromkeys(("codec", "timescale", "duration", "n_samples", "key_offsets", "key_lengths", "error"))
                if data is not None:
                    try:
                        if found := tracks(data):
                            t = found[0]
                            check_ranges(t, len(data))
                            row |= {"codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "key_offsets": t.offsets[t.keys].tolist(), "key_lengths": t.sizes[t.keys].tolist()}
                        else:
                            row["error"] = "no track"
                    except (ValueError, IndexError, struct.error) as bad:
                        row["error"] = str(bad)
                for k, v in row.items():
                    out[k].append(v)
            types = {"timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(), "key_offsets": pa.list_(pa.int64()), "key_lengths": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({k: v if k in keys else pa.array(v, types.get(k, pa.string())) for k, v in out.items()})

    return df.select(*keys, media).mapInArrow(describe, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", " + MEDIA)


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(-len(raw) % PACKET or (PACKET if not raw else 0))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a media file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            padded = [pad(t) for t in column(batch, "text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "n_bytes": pa.array([n for n, _ in padded], pa.int64()), "media": pa.array([wrap_payload(p) for _, p in padded], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests of the payload read back through the sample tables, and the media features as one JSON string."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {n.split()[0]: [] for n in DIGESTS.split(", ")}
            out["doc_id"], out["n_bytes"] = batch.column(0), batch.column(1)
            for data in column(batch, "media"):
                track = tracks(data)[0]
                payload = stored_bytes(data, track)
                ranges = np.column_stack([track.offsets[track.keys], track.sizes[track.keys]]).astype("<i8")
                feature = {"codec": track.codec, "timescale": track.timescale, "duration": track.duration, "samples": len(track.sizes), "keyframes": len(track.keys), "first_key": ranges[0].tolist(), "last_key": ranges[-1].tolist(), "key_ranges_crc32": zlib.crc32(ranges.tobytes())}
                for name, value in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-64:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", json.dumps(feature, separators=(",", ":")))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGESTS)


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(materialise(store_texts(documents(spark, sf_dir)), "media"))
