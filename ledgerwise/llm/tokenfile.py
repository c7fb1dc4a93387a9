"""Token files: ids bit-packed at the width that the vocabulary needs, readable at any place.

A file is a header (magic, bits per id, ids per block), blocks of ``BLOCK`` ids, an index and
the index's length. Ids are packed in groups of 64, which fill exactly ``bits`` 64-bit words,
so packing and unpacking are 64 shifts over whole columns. The index holds each block's byte
offset, each document's id (and whether it is null) and the position after its last token.

Documents are dealt by ranges of doc_id, one file each range, so file order and then place in
the file is doc_id order. Files go to the folder in ``spark.checkpoint.dir`` under a name of the
attempt and are then renamed; a task that runs again writes the same bytes.

Defined cases: a null text is the empty text, whose only token is the end id; null doc_ids come
first; equal doc_ids are ordered by a hash of the text, equal rows as they come, in as many files
as it takes; a very long text is one array of its ids; no rows give no files and no result; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._store import fresh
from .tokens import default_vocabulary, encoder, texts

MAGIC, BLOCK, READ = b"LWTOKEN1", 1 << 16, 1 << 21


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, padded with zeros to a multiple of 64, at `bits` bits each."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.ravel()[: len(ids)] = ids
    lanes, out = np.ascontiguousarray(rows.T), np.zeros((bits, len(rows)), np.uint64)
    for j in range(64):
        w, at = divmod(j * bits, 64)
        out[w] |= lanes[j] << np.uint64(at)
        if at + bits > 64:
            out[w + 1] |= lanes[j] >> np.uint64(64 - at)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of what pack() made."""
    words = np.ascontiguousarray(np.frombuffer(raw, "<u8").reshape(-1, bits).T)
    lanes, mask = np.empty((64, words.shape[1]), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(64):
        w, at = divmod(j * bits, 64)
        x = words[w] >> np.uint64(at)
        if at + bits > 64:
            x = x | words[w + 1] << np.uint64(64 - at)
        lanes[j] = x & mask
    return lanes.T.ravel()[:n]


class Writer:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.at, self.held, self.count = out, bits, 0, [], 0
        self.blocks, self.docs, self.ends, self.total = [], [], [], 0
        self._put(MAGIC + struct.pack("<II", bits, BLOCK))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        self.docs.append(doc_id)
        self.ends.append(self.total)
        if self.count >= BLOCK:
            self._flush(self.count // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for i in range(0, n, BLOCK):
            self.blocks.append(self.at)
            self._put(pack(ids[i : min(i + BLOCK, n)], self.bits))
        self.held, self.count = [ids[n:]], self.count - n

    def close(self) -> None:
        self._flush(self.count)
        index = struct.pack("<QQ", len(self.blocks), len(self.docs)) + np.array(self.blocks, "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.ends, "<u8").tobytes() + np.array([d is None for d in self.docs], np.uint8).tobytes()
        self._put(index + struct.pack("<Q", len(index)))


class Reader:
    """Random access to a token file: ``ids(a, b)`` reads the blocks that hold tokens a to b."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        head = file.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block = struct.unpack("<II", head[8:])
        (n,) = struct.unpack("<Q", file.read_at(8, end - 8))
        index = file.read_at(n, end - 8 - n)
        blocks, docs = struct.unpack("<QQ", index[:16])
        cut = lambda at, kind, k: np.frombuffer(index, kind, k, at)
        self.blocks = np.append(cut(16, "<u8", blocks), np.uint64(end - 8 - n)).astype(np.int64)
        self.docs = cut(16 + 8 * blocks, "<i8", docs)
        self.ends = cut(16 + 8 * (blocks + docs), "<u8", docs).astype(np.int64)
        self.null = cut(16 + 8 * (blocks + 2 * docs), np.uint8, docs).astype(bool)

    def ids(self, a: int, b: int) -> np.ndarray:
        first, last = a // self.block, -(-b // self.block)
        if a >= b:
            return np.zeros(0, np.uint32)
        total = int(self.ends[-1])
        raw = self.file.read_at(int(self.blocks[last] - self.blocks[first]), int(self.blocks[first]))
        # Whole blocks are multiples of 64 ids, so neighbours unpack as one.
        got = unpack(raw, min(last * self.block, total) - first * self.block, self.bits)
        return got[a - first * self.block : b - first * self.block]


def _write(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, base = fs.FileSystem.from_uri(folder)
        at.create_dir(base, recursive=True)
        path, trial = f"{base}/part-{part:06d}.ids", f"{base}/.trial-{uuid.uuid4().hex}"
        code, w = encoder(vocabulary), None
        with at.open_output_stream(trial) as out:
            w = Writer(out, max(1, (code.size - 1).bit_length()))
            for b in batches:
                for d, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                    w.add(d, code.ids(t))
            w.close()
        at.move(trial, path)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(w.docs)], pa.int64()), pa.array([w.total], pa.int64())], names=["part", "docs", "ids"])

    return run


def _read(folder: str, bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(folder)
        for part in (p for b in batches for p in b.column(0).to_pylist() if p in bases):
            with at.open_input_file(f"{base}/part-{part:06d}.ids") as file:
                r = Reader(file)
                starts = np.concatenate([[0], r.ends[:-1]]).astype(np.int64)
                i = 0
                while i < len(r.docs):  # documents of about READ ids at a time
                    j = max(i + 1, int(np.searchsorted(r.ends, starts[i] + READ, "right")))
                    ids = r.ids(int(starts[i]), int(r.ends[j - 1])).astype("<u4")
                    cut = [(int(a - starts[i]), int(b - starts[i])) for a, b in zip(starts[i:j], r.ends[i:j])]
                    raw = memoryview(ids.tobytes())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(r.docs[i:j], pa.int64(), mask=r.null[i:j]),
                        pa.array(starts[i:j] + bases[part]),
                        pa.array(r.ends[i:j] - starts[i:j]),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in cut], pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    return run


def write_tokens(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Write docs (doc_id, text) as token files; the folder, and (part, documents, ids) of each file, one for each task."""
    folder = folder or fresh(docs.sparkSession, "tokens")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))  # equal rows may be dealt to several ranges
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    parts = dealt.mapInArrow(_write(folder, vocabulary or default_vocabulary()), "part bigint, docs bigint, ids bigint").collect()
    return folder, sorted((r.part, r.docs, r.ids) for r in parts)


def read_tokens(spark, folder: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""
    bases, total = {}, 0
    for part, n, ids in parts:
        if n:
            bases[part] = total
        total += ids
    last = max(bases, default=0) + 1
    return spark.range(0, last, 1, last).mapInArrow(_read(folder, bases), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
