"""Binary media columns: lossless 8-bit PNG and a perceptual hash of low cosine frequencies.

`encode_text` stores a text's UTF-8 bytes, padded with zeros to whole rows, as a
grey-scale PNG.  `decode` walks the chunks, tests each checksum, inflates the
image data with a bound taken from the header, undoes the row filters with
numpy and computes the hash.  Both run per row inside Arrow batches; nothing is
shuffled.

Cases: null or empty text gives one row of 64 zero bytes; a text of any length
is one image; equal texts give equal bytes; a null or damaged image raises in
`read_png` and gives a null result with the reason in `error` from `decode`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 4
SIDE, LOW = 32, 8


class DamagedImage(ValueError):
    """The bytes are not a PNG this module can read whole."""


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """`data` with zeros added up to a positive multiple of `width`."""
    return data + bytes(-len(data) % width or (0 if data else width))


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey-scale PNG of rows of `width` bytes; each row takes the filter (none or left) with the smaller residue."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    weight = lambda a: np.abs(a.view(np.int8).astype(np.int16)).sum(axis=1)
    use = (weight(left) < weight(rows)).astype(np.uint8)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = use
    lines[:, 1:] = np.where(use[:, None] == 1, left, rows)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the five row filters; `lines` has the filter type in column 0."""
    kinds, data = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > 4:
        raise DamagedImage("unknown row filter")
    out = data.copy()
    if (kinds <= 1).all():
        on = kinds == 1
        part = data[on].reshape(int(on.sum()), data.shape[1] // bpp, bpp)
        out[on] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(len(part), data.shape[1])
        return out
    up = np.zeros(data.shape[1], np.uint8)
    for i, kind in enumerate(kinds):
        line = out[i]
        if kind == 1:
            line[:] = np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += up
        elif kind == 3:
            for x in range(len(line)):
                line[x] = (int(line[x]) + ((int(line[x - bpp]) if x >= bpp else 0) + int(up[x])) // 2) & 255
        elif kind == 4:
            for x in range(len(line)):
                a, c = (int(line[x - bpp]), int(up[x - bpp])) if x >= bpp else (0, 0)
                b = int(up[x])
                pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                line[x] = (int(line[x]) + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
        up = line
    return out


def read_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without interlacing, as rows x bytes."""
    if media[:8] != SIGNATURE:
        raise DamagedImage("no PNG signature")
    at, parts, size, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise DamagedImage("cut chunk")
        (n,), kind = struct.unpack(">I", media[at:at + 4]), media[at + 4:at + 8]
        data, crc = media[at + 8:at + 8 + n], media[at + 8 + n:at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + data):
            raise DamagedImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise DamagedImage("no header or no end")
    width, height, depth, colour, packing, filtering, laced = size
    bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or bands is None or packing or filtering or laced:
        raise DamagedImage("a form that is not read here")
    want = height * (width * bands + 1)
    engine = zlib.decompressobj()
    raw = engine.decompress(b"".join(parts), want + 1)
    if len(raw) != want or not engine.eof:
        raise DamagedImage("image data of another length")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), bands)


def _basis() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


BASIS = _basis()


def shrink(image: np.ndarray, axis: int) -> np.ndarray:
    """Mean over SIDE blocks of equal share along `axis`; a shorter axis is repeated."""
    n = image.shape[axis]
    if n < SIDE:
        return np.take(image, np.arange(SIDE) * n // SIDE, axis)
    edges = np.arange(SIDE + 1) * n // SIDE
    sums = np.add.reduceat(image, edges[:-1], axis=axis)
    width = np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
    return sums / width


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: is each of the 8 x 8 lowest cosine terms above their median (the mean term left out)?"""
    small = shrink(shrink(image.astype(np.float64), 0), 1)
    low = np.round(BASIS @ small @ BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


MEDIA = "doc_id {}, n_bytes long, media binary"
FEATURES = ("doc_id {}, n_bytes long, payload binary, payload_bytes long, payload_sha256 string, tail_crc32 long, "
            "media_bytes long, media_sha256 string, feature string, phash binary, error string")


def encode_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding), media (the PNG)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()),
                 pa.array([write_png(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, MEDIA.format(rows.schema["doc_id"].dataType.simpleString()))


def features(media: bytes | None) -> tuple:
    """Everything read back from one stored image."""
    try:
        image = read_png(media or b"")
    except (DamagedImage, zlib.error, struct.error) as why:
        return (None,) * 8 + (str(why),)
    payload = image.tobytes()
    bits = cosine_hash(image)
    return (payload, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
            hashlib.sha256(media).hexdigest(), bits.hex(), bits, None)


def decode(stored: DataFrame, keep_payload: bool = True) -> DataFrame:
    """`encode_text` rows read back: payload, digests and the perceptual hash.  See FEATURES."""
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = ["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "phash", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x) for x in batch.column(2).to_pylist()]
            if not keep_payload:
                rows = [(None, *x[1:]) for x in rows]
            made = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "n_bytes", *names])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run, FEATURES.format(stored.schema["doc_id"].dataType.simpleString()))
