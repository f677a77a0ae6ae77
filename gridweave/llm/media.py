"""Media columns: images in Netpbm or BMP form, decoded to numpy, resized by integral images, kept as NPY tiles.

Supported: binary and plain PGM and PPM (P2, P3, P5, P6) with up to 255 levels, and uncompressed 8-bit or 24-bit BMP.
Samples of fewer levels are scaled to 255; samples or palette places beyond the last level make an image undecodable.
A null or undecodable image gives nulls in the results of `tiles`; an empty table gives an empty one. Each row is handled
alone, so repeated rows give repeated results and ties need no rule; a very long text is one payload, held whole, beside
few others. Columns other than those asked for are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridweave.llm.common import chunks_by_size, column_bytes, column_list

SIDE = 24
TILE = SIDE * SIDE
_HEADER = re.compile(rb"(P[2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:#[^\n]*\n)?\s")


def encode_pgm(a: np.ndarray) -> bytes:
    """A grey image (height, width) of 8-bit samples as binary PGM."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """A colour image (height, width, 3) as uncompressed 24-bit BMP, rows from the bottom and padded to four bytes."""
    h, w, _ = a.shape
    row = -(-w * 3 // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = a[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + h * row, 0, 0, 54, 40, w, h, 1, 24, 0, h * row, 2835, 2835, 0, 0) + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Samples of a Netpbm or BMP image: (height, width) or (height, width, 3). Raises ValueError for anything else."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    m = _HEADER.match(data)
    if not m or max(map(len, m.groups())) > 9 or not 0 < int(m[4]) < 256:
        raise ValueError("not a supported image")
    w, h, planes = int(m[2]), int(m[3]), 3 if m[1] in (b"P3", b"P6") else 1
    n = w * h * planes
    if m[1] in (b"P5", b"P6"):
        a = np.frombuffer(data, np.uint8, n, m.end()) if len(data) - m.end() >= n else np.empty(0, np.uint8)
    else:
        words = re.sub(rb"#[^\n]*", b"", data[m.end() :]).split()[:n]
        if not all(len(x) < 10 and x.isdigit() for x in words):
            raise ValueError("a sample is no number of a level")
        a = np.array(words, dtype=np.int64)
    if not n or len(a) != n:
        raise ValueError("the image is cut off")
    top = int(m[4])
    if a.max() > top:
        raise ValueError("a sample is beyond the last level")
    a = a.astype(np.uint8) if top == 255 else np.rint(a * (255 / top)).astype(np.uint8)
    return a.reshape((h, w, 3) if planes == 3 else (h, w))


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("the image is cut off")
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24) or w <= 0 or not h:
        raise ValueError("not a supported image")
    row, rows = -(-w * bits // 32) * 4, abs(h)
    if start < 14 + size or len(data) < start + row * rows:
        raise ValueError("the image is cut off")
    a = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)
    a = a[::-1] if h > 0 else a
    if bits == 24:
        return a[:, : w * 3].reshape(rows, w, 3)[:, :, ::-1]
    entries = (start - 14 - size) // 4
    if entries <= int(a[:, :w].max()):
        raise ValueError("a sample is beyond the palette")
    colours = np.frombuffer(data, np.uint8, entries * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    return colours[a[:, :w]]


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each new sample covers, fractions of samples included, from the image's integral."""
    h, w = a.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def along(t: np.ndarray, n: int, parts: int) -> np.ndarray:
        edge = np.arange(parts + 1) * (n / parts)
        low = np.minimum(edge.astype(np.int64), n - 1)
        return t[low] + (t[low + 1] - t[low]) * (edge - low)[:, None]

    t = along(along(total, h, height).T, w, width).T
    return (t[1:, 1:] - t[:-1, 1:] - t[1:, :-1] + t[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(a: np.ndarray) -> str:
    """64 bits as hex: is each of 8 by 9 resized samples darker than its right neighbour."""
    small = np.round(area_resize(grey(a), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def to_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tiles(images: DataFrame, key: str, image: str, height: int = SIDE, width: int = SIDE) -> DataFrame:
    """For each image: its size, an NPY tile of the grey image resized to (height, width), and its difference hash."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in column_list(b, "_image"):
                try:
                    a = decode(data or b"")
                    rows.append((*a.shape[:2], to_npy(np.clip(np.rint(area_resize(grey(a), height, width)), 0, 255).astype(np.uint8)), difference_hash(a)))
                except ValueError:
                    rows.append((None, None, None, None))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True))], names=["key", "height", "width", "tile", "dhash"])

    made = images.select(images[key].alias("key"), images[image].alias("_image")).mapInArrow(run, f"key {kind}, height int, width int, tile binary, dhash string")
    return made.withColumnRenamed("key", key)


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 text with bytes 255 appended up to a positive multiple of a tile's samples."""
    text = text or b""
    return text + b"\xff" * (max(TILE, -(-len(text) // TILE) * TILE) - len(text))


def store_text(text: bytes | None) -> bytes:
    """A text as NPY tiles of 8-bit samples: its payload is a PGM image of one tile's width, decoded and cut into tiles."""
    payload = payload_of(text)
    image = decode(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, SIDE)))
    return to_npy(image.reshape(-1, SIDE, SIDE))


def text_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and `media`, the NPY tiles that hold the whole text. Null text counts as empty; equal texts give equal media."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column_bytes(b, "text")
            for part in chunks_by_size(texts, 8_000_000):
                own = texts[part]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, len(own)), pa.array([len(t or b"") for t in own], pa.int64()), pa.array([store_text(t) for t in own], pa.binary())], names=["key", "n_bytes", "media"])

    made = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary")
    return made.withColumnRenamed("key", key)


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored tiles back: payload length and digests, the stored form's own, and the difference hash of the image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stored in column_list(b, "media"):
                a = from_npy(stored)
                payload = a.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(a.reshape(-1, SIDE))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
