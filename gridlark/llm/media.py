"""ISO base media files: write samples into one, and read what its boxes tell without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridlark.llm.common import ship

SAMPLE_BYTES = 64
CHUNK_SAMPLES = 256
RATE = 8000

# Boxes of ISO/IEC 14496-12 that hold other boxes, and the bytes before those.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"dref": 8}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write(payload: bytes) -> bytes:
    """A file with one audio track of unsigned 8-bit PCM (`raw `), a sample table over SAMPLE_BYTES long samples
    in chunks of CHUNK_SAMPLES, and the payload unchanged in one `mdat`. len(payload) is a positive multiple of
    SAMPLE_BYTES."""
    n = len(payload) // SAMPLE_BYTES
    if not n or n * SAMPLE_BYTES != len(payload):
        raise ValueError("the payload must be a positive multiple of the sample size")
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ticks = n * SAMPLE_BYTES
    n_chunks = -(-n // CHUNK_SAMPLES)
    last = n - (n_chunks - 1) * CHUNK_SAMPLES
    to_chunk = [(1, CHUNK_SAMPLES, 1)] * (n_chunks > 1) + [(n_chunks, last, 1)] * (last != CHUNK_SAMPLES or n_chunks == 1)

    def moov(first: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
        chunk_at = [first + i * CHUNK_SAMPLES * SAMPLE_BYTES for i in range(n_chunks)]
        wide = first + len(payload) >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE_BYTES)),
            full(b"stss", struct.pack(f">I{n_chunks}I", n_chunks, *range(1, n + 1, CHUNK_SAMPLES))),
            full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">III", *x) for x in to_chunk)),
            full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{n_chunks}{'Q' if wide else 'I'}", n_chunks, *chunk_at)),
        )
        info = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, ticks, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), info)
        head = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), unity, struct.pack(">II", 0, 0), flags=3)
        movie = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, ticks, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", movie, box(b"trak", head, media))

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    lead = len(kind) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return kind + moov(lead + len(moov(1 << 33 if len(payload) >= 1 << 31 else 0))) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, start of the body, end) of each box, parents first. A box whose size goes beyond its parent ends there."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        lead = 8
        if size == 1 and start + 16 <= end:
            size, lead = struct.unpack_from(">Q", data, start + 8)[0], 16
        stop = end if size == 0 else min(start + size, end)
        if stop < start + lead:
            return
        yield (*path, kind), start + lead, stop
        if kind in CONTAINERS:
            yield from walk(data, start + lead + CONTAINERS[kind], stop, (*path, kind))
        start = stop


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    times: list = field(default_factory=list)
    key_samples: list | None = None
    to_chunk: list = field(default_factory=list)
    sizes: list | None = None
    size: int = 0
    n_samples: int = 0
    chunks: list = field(default_factory=list)

    def sample_size(self, i: int) -> int:
        return self.size or self.sizes[i]

    def ranges(self) -> list[tuple[int, int, int]]:
        """(first sample from 0, byte offset, bytes) of each chunk, from the sample table."""
        out, sample = [], 0
        for k, at in enumerate(self.chunks, 1):
            n = next((c[1] for c in reversed(self.to_chunk) if c[0] <= k), 0)
            n = min(n, self.n_samples - sample)
            out.append((sample, at, n * self.size if self.size else sum(self.sizes[sample : sample + n])))
            sample += n
        return out

    def keyframes(self) -> list[tuple[int, int]]:
        """(byte offset, bytes) of each keyframe: of every sample where no table names them."""
        wanted = range(self.n_samples) if self.key_samples is None else [k - 1 for k in self.key_samples]
        spans, out, c = self.ranges(), [], 0
        for i in wanted:
            while c + 1 < len(spans) and spans[c + 1][0] <= i:
                c += 1
            first, at, _ = spans[c]
            before = (i - first) * self.size if self.size else sum(self.sizes[first:i])
            out.append((at + before, self.sample_size(i)))
        return out


def read(data: bytes) -> list[Track]:
    """The tracks of a file, from its box headers and sample tables; payload bytes aren't looked at."""
    tracks: list[Track] = []

    def table(at: int, form: str) -> list[tuple]:
        n, one = struct.unpack_from(">I", data, at + 4)[0], struct.calcsize(form)
        return list(struct.iter_unpack(form, data[at + 8 : at + 8 + n * one]))

    for path, at, _ in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append(Track())
        elif not tracks:
            continue
        elif kind == b"mdhd":
            form = ">QQIQ" if data[at] else ">IIII"
            tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(form, data, at + 4)[2:]
        elif kind == b"hdlr" and b"mdia" in path:
            tracks[-1].kind = data[at + 8 : at + 12].decode("latin-1")
        elif path[-2:-1] == (b"stsd",) and not tracks[-1].codec:
            tracks[-1].codec = kind.decode("latin-1")
        elif kind == b"stts":
            tracks[-1].times = table(at, ">II")
        elif kind == b"stss":
            tracks[-1].key_samples = [x for (x,) in table(at, ">I")]
        elif kind == b"stsc":
            tracks[-1].to_chunk = table(at, ">III")
        elif kind == b"stsz":
            tracks[-1].size, tracks[-1].n_samples = struct.unpack_from(">II", data, at + 4)
            tracks[-1].sizes = None if tracks[-1].size else [x for (x,) in struct.iter_unpack(">I", data[at + 12 : at + 12 + 4 * tracks[-1].n_samples])]
        elif kind in (b"stco", b"co64"):
            tracks[-1].chunks = [x for (x,) in table(at, ">I" if kind == b"stco" else ">Q")]
    return tracks


def payload(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, read by the ranges of its sample table."""
    return b"".join(data[at : at + n] for _, at, n in track.ranges())


def padded(raw: bytes, unit: int = SAMPLE_BYTES) -> bytes:
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


DESCRIBED = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("codec", T.StringType()), T.StructField("timescale", T.LongType()),
    T.StructField("duration", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("key_offsets", T.ArrayType(T.LongType())), T.StructField("key_bytes", T.ArrayType(T.LongType())),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def describe(raw: bytes, keep: bool = True) -> dict:
    """Store raw, padded with zeros to full samples, in a file, and tell what reading that file back gives."""
    data = write(padded(raw))
    (track,) = read(data)
    stored, keys = payload(data, track), track.keyframes()
    feature = f"kind={track.kind};codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={track.n_samples};chunks={len(track.chunks)};keyframes={len(keys)};first_key={keys[0][0]}+{keys[0][1]};last_key={keys[-1][0]}+{keys[-1][1]}"
    return {
        "n_bytes": len(raw), "media": data if keep else None, "codec": track.codec, "timescale": track.timescale, "duration": track.duration, "n_samples": track.n_samples, "key_offsets": [k for k, _ in keys], "key_bytes": [n for _, n in keys],
        "payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-64:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature,
    }


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """One row for each row of df: the text's UTF-8 bytes as an ISO media file, and what its boxes tell.

    Columns: key and those of DESCRIBED: `media` is the file (null unless keep_media), key_offsets and key_bytes are the byte ranges of
    the keyframes in it. A null text counts as empty: one sample of zeros. Equal texts give equal files; repeated rows are
    described each; an empty table gives no rows. Other columns of df aren't read. Narrow: no shuffle,
    and no more than a batch's results are held.
    """
    ship(df.sparkSession)
    rows = df.select(df[key].alias("key"), F.encode(df[text], "utf-8").alias("raw"))
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *DESCRIBED.fields])
    names = [f.name for f in DESCRIBED.fields]
    kinds = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
    types = [kinds[f.dataType] for f in DESCRIBED.fields]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [describe(raw or b"", keep_media) for raw in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[n] for x in found], t) for n, t in zip(names, types, strict=True))], names=[key, *names])

    return rows.mapInArrow(run, schema)
