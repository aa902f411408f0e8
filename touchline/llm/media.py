"""Media columns: ISO base media files (nested boxes) written from and read back to table rows.

The writer stores a payload as fixed-size samples of one PCM track. The reader walks the boxes, decodes the
sample tables (time-to-sample, sample-to-chunk, sizes, chunk offsets, sync samples) and reports codec,
duration and the byte ranges of keyframes; it never decodes the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import quoted, table

#: Bytes of one stored sample; payloads are padded with spaces to a positive multiple.
UNIT = 192
TIMESCALE = 8000
SAMPLES_PER_CHUNK = 64
KEYFRAME_EVERY = 16
CODEC = b"raw "
#: Boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    """A box; bodies beyond 32-bit sizes get the 64-bit size field."""
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT or (UNIT if not data else 0))


def write_container(payload: bytes) -> bytes:
    """payload: a positive multiple of UNIT bytes."""
    n = len(payload) // UNIT
    chunks = -(-n // SAMPLES_PER_CHUNK)
    rest = n - (chunks - 1) * SAMPLES_PER_CHUNK
    sync = np.arange(1, n + 1, KEYFRAME_EVERY, dtype=">u4")
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if chunks > 1 else []
    if rest != SAMPLES_PER_CHUNK or not runs:
        runs.append((chunks, rest, 1))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    duration = n * UNIT

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (SAMPLES_PER_CHUNK * UNIT)
        wide = first + len(payload) >= 1 << 32
        stco = full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
        entry = box(CODEC, b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            stco,
            full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", b"\0" * 4), dinf, stbl)
        hdlr = full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"\0")
        wide_time = duration >= 1 << 32
        stamp = struct.pack(">QQIQ", 0, 0, TIMESCALE, duration) if wide_time else struct.pack(">IIII", 0, 0, TIMESCALE, duration)
        version = 1 << 24 if wide_time else 0
        mdia = box(b"mdia", full(b"mdhd", stamp, struct.pack(">HH", 0x55C4, 0), flags=version), hdlr, minf)
        track = struct.pack(">QQIIQ", 0, 0, 1, 0, duration) if wide_time else struct.pack(">IIIII", 0, 0, 1, 0, duration)
        tkhd = full(b"tkhd", track, b"\0" * 60, flags=version | 3)
        mvhd = full(b"mvhd", stamp, b"\0" * 76, struct.pack(">I", 2), flags=version)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0))
    lead = 8 if len(payload) + 8 < 1 << 32 else 16
    return b"".join((ftyp, moov(head + lead), box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box types, start and end of the body) of all boxes, outer ones first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit its parent")
        here = (*path, kind)
        yield here, body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, here)
        start += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    starts: np.ndarray
    sizes: np.ndarray
    sync: np.ndarray
    #: (start, end) in the file of each keyframe, end exclusive
    keyframes: np.ndarray


def _u4(data: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(data, ">u4", n, at).astype(np.int64)


def read_track(data: bytes) -> Track:
    """The first track's sample tables, resolved to byte ranges of the file."""
    at: dict[bytes, tuple[int, int]] = {}
    for path, start, end in walk(data):
        at.setdefault(path[-1], (start, end))
    version = data[at[b"mdhd"][0]]
    scale, duration = struct.unpack_from(">IQ" if version else ">II", data, at[b"mdhd"][0] + (20 if version else 12))
    codec = data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16].decode("latin-1")
    pos = at[b"stsz"][0]
    fixed, n = struct.unpack_from(">II", data, pos + 4)
    sizes = np.full(n, fixed, np.int64) if fixed else _u4(data, pos + 12, n)
    if b"co64" in at:
        (chunks,) = struct.unpack_from(">I", data, at[b"co64"][0] + 4)
        offsets = np.frombuffer(data, ">u8", chunks, at[b"co64"][0] + 8).astype(np.int64)
    else:
        (chunks,) = struct.unpack_from(">I", data, at[b"stco"][0] + 4)
        offsets = _u4(data, at[b"stco"][0] + 8, chunks)
    (m,) = struct.unpack_from(">I", data, at[b"stsc"][0] + 4)
    runs = _u4(data, at[b"stsc"][0] + 8, 3 * m).reshape(m, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], chunks + 1)))
    chunk_of = np.repeat(np.arange(chunks), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    starts = offsets[chunk_of] + before - before[first[chunk_of]]
    if b"stss" in at:
        (k,) = struct.unpack_from(">I", data, at[b"stss"][0] + 4)
        sync = _u4(data, at[b"stss"][0] + 8, k) - 1
    else:
        sync = np.arange(n)
    return Track(codec, scale, duration, starts, sizes, sync, np.stack([starts[sync], starts[sync] + sizes[sync]], 1))


def read_payload(data: bytes, track: Track) -> bytes:
    """The stored samples in order; runs of adjacent samples are read at once."""
    if not len(track.starts):
        return b""
    ends = track.starts + track.sizes
    cut = np.flatnonzero(track.starts[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(track.starts[np.append(0, cut)], ends[np.append(cut - 1, len(ends) - 1)], strict=True))


def feature(track: Track) -> str:
    """Codec, duration in seconds, sample and keyframe counts, first and last keyframe, digest of all ranges."""
    frames = track.keyframes
    ranges = ",".join(f"{a}-{b}" for a, b in frames[[0, -1]]) if len(frames) else ""
    crc = zlib.crc32(frames.astype("<i8").tobytes())
    return (
        f"codec={track.codec.strip()};seconds={track.duration / max(1, track.timescale):.6f};samples={len(track.sizes)};"
        f"keyframes={len(frames)};ranges={ranges};ranges_crc32={crc}"
    )


SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, codec string, duration_s double, keyframes long, keyframe_ranges array<struct<start:long,end:long>>"
)


def media_features(df: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """One row per row of df: key, the columns of SCHEMA (keyframe_ranges in bytes of the container, end
    exclusive) and, with_media, the container itself.

    Null texts count as empty; an empty text is stored as one unit of spaces. Other columns are ignored, and
    repeated rows give repeated results; an empty table gives no rows. A container holds one text, so a task's
    memory is bounded by a batch of texts.
    """

    def ranges_of(frames: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate(frames) if frames else np.zeros((0, 2), np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
        pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k]), pa.int64()) for k in (0, 1)], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, frames = [], []
            for v in b.column("data"):
                raw = v.as_py() or b""
                media = write_container(padded(raw))
                track = read_track(media)
                payload = read_payload(media, track)
                frames.append(track.keyframes)
                rows.append(
                    (
                        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
                        hashlib.sha256(media).hexdigest(), feature(track), track.codec, track.duration / track.timescale,
                        len(track.keyframes), *([media] if with_media else []),
                    )
                )
            cols = list(zip(*rows, strict=True)) or [()] * (10 + with_media)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
            arrays.insert(10, ranges_of(frames))
            yield pa.RecordBatch.from_arrays([b.column("key"), *arrays], names=[key, *(f.name for f in fields)])

    src = df.select(quoted(key).alias("key"), quoted(text).cast("binary").alias("data"))
    fields = T.StructType.fromDDL(SCHEMA + ", media binary" * with_media).fields
    return src.mapInArrow(run, T.StructType([T.StructField(key, src.schema["key"].dataType), *fields]))


def query(spark, sf_dir):
    return media_features(table(spark, sf_dir, "documents"))
