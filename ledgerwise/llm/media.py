"""Payloads as PNG images in a binary column, read back chunk by chunk.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the rows of a grey
image 64 samples wide, written as PNG with unfiltered rows (text compresses best so). The
reader takes any 8-bit grey PNG without interlacing: it tests each chunk's checksum, joins and
inflates the IDAT chunks, and undoes all five row filters. A feature is the sign pattern of the
lowest 8 x 8 cosine-transform coefficients of the image averaged to 32 x 32, as 16 hex digits.

Defined cases: null and empty text are one row of zeros; equal texts give equal bytes; repeated
rows are stored each; a very long text is one tall image, its body cut into chunks; ties with the
median count as below it; no rows give no result; a broken chunk, checksum or size raises
ValueError. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import stash
from .tokens import texts

WIDTH, SIDE, LOW, CHUNK = 64, 32, 8, 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(data: bytes, level: int = 6) -> bytes:
    """A grey image of rows of WIDTH samples; data is a positive multiple of WIDTH."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    raw = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), level)  # filter 0 before each row
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", raw[i : i + CHUNK]) for i in range(0, len(raw), CHUNK)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of rows that begin with their filter's number; one byte a sample."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if not kinds.any():
        return out
    if (kinds == 2).all():
        return np.cumsum(out, axis=0, dtype=np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for kind, row in zip(kinds.tolist(), out):
        if kind == 1:
            row[:] = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            left = corner = 0
            for x, up in enumerate(above.tolist()):
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    near = abs(p - left), abs(p - up), abs(p - corner)
                    guess = (left, up, corner)[near.index(min(near))]
                corner, left = up, (int(row[x]) + guess) & 255
                row[x] = left
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        above = row
    return out


def read_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, after its checksums are tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(media) and not ended:
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data, check = media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"bad checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey image")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("wrong size")
    return _unfilter(raw.reshape(head[1], head[0] + 1))


_COS = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5)[None, :] * np.arange(LOW)[:, None])


def _averages(x: np.ndarray, n: int) -> np.ndarray:
    """n equal shares of the rows of x, each averaged; a share may take part of a row."""
    sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=float)])
    edge = np.linspace(0, len(x), n + 1)
    i = np.minimum(edge.astype(int), len(x) - 1)
    at = sums[i] + (edge - i)[:, None] * (sums[i + 1] - sums[i])
    return np.diff(at, axis=0) * (n / len(x))


def feature(image: np.ndarray) -> str:
    small = _averages(_averages(image, SIDE).T, SIDE).T
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, media = [], []
        for t in texts(b.column(1)):
            size.append(len(t))
            media.append(write_png(payload(t)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for m in texts(b.column(2)):
            image = read_png(m)
            data = image.tobytes()
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(image)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the image of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id bigint, n_bytes bigint, media binary")


def measure(media: DataFrame) -> DataFrame:
    """What is read back from stored images (doc_id, n_bytes, media)."""
    kind = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_measure, kind)


def stored(docs: DataFrame) -> DataFrame:
    """to_media(), written to the shared folder and read again."""
    return stash(to_media(docs), "media")
