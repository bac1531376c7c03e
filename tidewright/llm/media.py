"""Operator 9: ISO media containers in binary columns.

``describe`` walks the nested boxes of a container and decodes its sample tables (sizes, chunk map,
chunk offsets, times, sync samples) into codec, duration and the byte ranges of samples and key
frames; payloads are never decoded. ``wrap`` writes the smallest container that holds a payload as
8-bit samples: a file-type box, a movie box with one track and a media-data box.

Defined results: a null or empty text is wrapped as 64 zero bytes; a null container, or one that is
cut short or not of this format, gives a row with ``error`` set and no ranges; repeated rows stay
repeated; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

UNIT = 64
UNITS_A_CHUNK = 64
KEY_EVERY = 16
RATE = 8000
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    return struct.pack(">I", 8 + sum(map(len, body))) + kind + b"".join(body)


def full_box(kind: bytes, *body: bytes) -> bytes:
    return box(kind, bytes(4), *body)


def wrap(payload: bytes) -> bytes:
    """``payload``, a positive multiple of UNIT bytes, as one track of 8-bit samples."""
    n = len(payload) // UNIT
    chunks = -(-n // UNITS_A_CHUNK)
    last = n - (chunks - 1) * UNITS_A_CHUNK
    runs = [(1, UNITS_A_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != UNITS_A_CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY).astype(">u4")
    wide = len(payload) > 0xFFFF0000
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp41")

    def movie(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.uint64) * (UNITS_A_CHUNK * UNIT)
        entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">3I", 1, n, UNIT)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">2I", UNIT, n)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), stbl)
        time = struct.pack(">4I", 0, 0, RATE, min(n * UNIT, 0xFFFFFFFF))
        mdia = box(b"mdia", full_box(b"mdhd", time, b"\x55\xc4\0\0"), full_box(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = box(b"tkhd", b"\0\0\0\7", struct.pack(">5I8x4H", 0, 0, 1, 0, min(n * UNIT, 0xFFFFFFFF), 0, 0, 0x100, 0), MATRIX, bytes(8))
        return box(b"moov", full_box(b"mvhd", time, struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2)), box(b"trak", tkhd, mdia))

    lead = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    moov = movie(len(head) + len(movie(0)) + len(lead))
    return b"".join((head, moov, lead, payload))


def boxes(blob: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end of its content) of the boxes from ``at``; a box that leaves its parent is
    an error."""
    while at < end:
        if end - at < 8:
            raise ValueError("box header cut short")
        size, kind = struct.unpack_from(">I4s", blob, at)
        start = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("box header cut short")
            size, start = struct.unpack_from(">Q", blob, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < start - at or at + size > end:
            raise ValueError(f"box {kind!r} exceeds its parent")
        yield kind, start, at + size
        at += size


def tree(blob: memoryview, at: int, end: int) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box with the path of kinds above it, parents first."""
    for kind, start, stop in boxes(blob, at, end):
        yield (kind,), start, stop
        if kind in NESTED:
            for path, a, b in tree(blob, start, stop):
                yield (kind, *path), a, b


def numbers(blob: memoryview, at: int, end: int, kind: str, n: int) -> np.ndarray:
    if n * np.dtype(kind).itemsize > end - at:
        raise ValueError("sample table cut short")
    return np.frombuffer(blob, kind, n, at).astype(np.int64)


def track(blob: memoryview, at: int, end: int) -> dict:
    """Codec, times and the byte ranges of one track's samples."""
    found = {path[-1]: (a, b) for path, a, b in tree(blob, at, end)}
    for need in (b"mdhd", b"stsd", b"stts", b"stsc"):
        if need not in found:
            raise ValueError(f"no {need.decode()} box")
    a, b = found[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", blob, a + 20) if blob[a] else struct.unpack_from(">II", blob, a + 12)
    a, b = found[b"stsd"]
    codec = bytes(blob[a + 12 : a + 16]).decode("latin-1") if b - a >= 16 else ""

    def listed(kind: bytes, dtype: str, width: int) -> np.ndarray:
        a, b = found[kind]
        n = struct.unpack_from(">I", blob, a + 4)[0]
        return numbers(blob, a + 8, b, dtype, n * width).reshape(-1, width)

    a, b = found.get(b"stsz", (0, 0))
    if not b:
        raise ValueError("no stsz box")
    each, n = struct.unpack_from(">II", blob, a + 4)
    sizes = np.full(n, each, np.int64) if each else numbers(blob, a + 12, b, ">u4", n)
    offsets = (listed(b"co64", ">u8", 1) if b"co64" in found else listed(b"stco", ">u4", 1))[:, 0] if {b"co64", b"stco"} & found.keys() else np.empty(0, np.int64)
    runs = listed(b"stsc", ">u4", 3)
    upto = np.append(runs[1:, 0], len(offsets) + 1)
    in_chunk = np.repeat(runs[:, 1], np.maximum(upto - runs[:, 0], 0))  # samples of each chunk
    if in_chunk.sum() != n or len(in_chunk) != len(offsets):
        raise ValueError("chunk map and sample sizes disagree")
    chunk = np.repeat(np.arange(len(offsets)), in_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(in_chunk) - in_chunk  # the first sample of each chunk
    starts = offsets[chunk] + before - before[first[chunk]] if n else np.empty(0, np.int64)
    if n and (starts.min() < 0 or (starts + sizes).max() > len(blob)):
        raise ValueError("a sample lies outside the file")
    keys = listed(b"stss", ">u4", 1)[:, 0] - 1 if b"stss" in found else np.arange(n)
    times = listed(b"stts", ">u4", 2)
    return {"codec": codec, "timescale": timescale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()), "starts": starts, "sizes": sizes, "keys": keys[(keys >= 0) & (keys < n)]}


def tracks(blob: bytes) -> list[dict]:
    view = memoryview(blob)
    return [track(view, a, b) for path, a, b in tree(view, 0, len(view)) if path[-1] == b"trak"]


def samples(blob: bytes, t: dict) -> bytes:
    """The stored bytes of a track; neighbouring ranges are read as one."""
    starts, ends = t["starts"], t["starts"] + t["sizes"]
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != ends[:-1])
    return b"".join(blob[a:b] for a, b in zip(starts[np.append(0, cut + 1)].tolist(), ends[np.append(cut, len(ends) - 1)].tolist()))


RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))


def describe(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per container and track: key, track, codec, timescale, duration (ticks), n_samples,
    keyframes array<struct<offset, length>>, error."""
    df = df.select(key, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for k, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                try:
                    got = tracks(blob or b"")
                    if not got:
                        raise ValueError("no track")
                    for i, t in enumerate(got):
                        ranges = [{"offset": int(a), "length": int(b)} for a, b in zip(t["starts"][t["keys"]], t["sizes"][t["keys"]])]
                        rows.append((k, i, t["codec"], t["timescale"], t["duration"], len(t["sizes"]), ranges, None))
                except (ValueError, struct.error) as e:
                    rows.append((k, None, None, None, None, None, None, str(e)))
            types = [part.column(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), RANGES, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [key, "track", "codec", "timescale", "duration", "n_samples", "keyframes", "error"])

    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, track int, codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset: long, length: long>>, error string")


def wrap_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text, padded with zero bytes, in a container of its own."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([wrap(padded((t or "").encode())) for t in part.column("text").to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or UNIT * (not data))


def feature(blob: bytes, t: dict, payload: bytes) -> str:
    """What the container's tables and stored samples say, as text."""
    level = np.frombuffer(payload, np.uint8)
    first, last = t["keys"][0], t["keys"][-1]
    ranges = ",".join(f"{t['starts'][k]}+{t['sizes'][k]}" for k in dict.fromkeys((first, last)))
    return f"codec={t['codec'].strip()};seconds={t['duration'] / t['timescale']:.3f};samples={len(t['sizes'])};keyframes={len(t['keys'])};ends={ranges};mean={level.mean():.4f};peak={level.max()}"


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every text through a container: written, walked, read back by its ranges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_keyframes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                data = (text or "").encode()
                blob = wrap(padded(data))
                (t,) = tracks(blob)
                back = samples(blob, t)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(blob, t, back), t["codec"], t["duration"], len(t["keys"])))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), types))], names)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, n_keyframes long")
