import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from gridlark.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=70_000))
def test_round_trip(raw):
    data = media.write(media.padded(raw))
    (track,) = media.read(data)
    assert media.payload(data, track) == media.padded(raw) and len(media.padded(raw)) % 64 == 0
    assert (track.kind, track.codec, track.timescale) == ("soun", "raw ", media.RATE) and track.duration == len(media.padded(raw)) == sum(n * d for n, d in track.times)
    spans = track.ranges()
    assert sum(n for _, _, n in spans) == len(media.padded(raw)) and track.keyframes() == [(at, 64) for _, at, _ in spans]


def test_boxes():
    data = media.write(bytes(64 * 300))
    paths = [p for p, _, _ in media.walk(data)]
    assert [p for p in paths if len(p) == 1] == [(b"ftyp",), (b"moov",), (b"mdat",)] and (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd", b"raw ") in paths
    assert media.read(data[:40]) == [] and list(media.walk(b"\0\0\0\4abcd")) == []
    with pytest.raises(ValueError):
        media.write(b"abc")


def test_other_tables():
    """Sizes of their own per sample, sync samples, several samples a chunk and 64-bit offsets."""
    t = media.Track(sizes=[5, 6, 7, 8], n_samples=4, to_chunk=[(1, 1, 1), (2, 3, 1)], chunks=[100, 200], key_samples=[1, 3])
    assert t.ranges() == [(0, 100, 5), (1, 200, 21)] and t.keyframes() == [(100, 5), (206, 7)]
    body = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 600, 1 << 33, 0, 0), version=1), media.box(b"minf", media.box(b"stbl", media.full(b"co64", struct.pack(">IQ", 1, 1 << 34)))))))
    (track,) = media.read(body)
    assert (track.timescale, track.duration, track.chunks) == (600, 1 << 33, [1 << 34])


def test_columns(spark, tricky):
    rows = media.media_columns(tricky).collect()
    texts = {r.doc_id: r.text for r in tricky.collect()}
    assert len(rows) == tricky.count() and media.media_columns(tricky.where("false")).count() == 0
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        stored = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert b"".join(r.media[a : a + n] for a, n in zip(r.key_offsets, r.key_bytes, strict=True))[:64] == stored[:64]
