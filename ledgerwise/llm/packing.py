"""Sum-of-squares packing of token pieces into sequences.

Documents are encoded and only those longer than a sequence are cut. The pieces are dealt
evenly into groups of about ``GROUP``, which are packed apart; a group wastes part of a
sequence. In a group pieces go in decreasing length. N(g) is the number of open sequences with
g tokens free; a piece of length s goes into the gap g >= s, or into a new sequence, so that
the sum of all N(g)**2 becomes smallest. Once the open sequences have room for all that is left,
a new one is opened only where none has room for the piece.

Defined cases: null text is the empty text, one end id; a very long text is cut, a piece of
full length fills a sequence; repeated rows and ties are packed each, ties of gaps into the
smaller one; no rows give no result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._store import stash
from .tokens import LIMIT, default_vocabulary, encoder, texts

LENGTH, GROUP = 4096, 100_000


def _pieces(vocabulary: str, length: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary, cache)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                ids = code.ids(t)
                for k, a in enumerate(range(0, len(ids), length)):
                    x = ids[a : a + length]
                    out.append((d, k, a, len(x), zlib.crc32(x)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def sum_of_squares(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its sequence, numbered from 0, and its place there."""
    count = np.zeros(length + 1, np.int64)  # count[0] stays 0: a full sequence is no longer open
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    where, place, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    left, room = int(lengths.sum()), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        here = count[s:]
        gaps, g = np.flatnonzero(here), length
        if len(gaps):
            change = 2 * (count[gaps] - here[gaps]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * here[0]
            best = int(np.argmin(change))
            if left <= room or s < length and change[best] <= 2 * count[length - s] + 1:
                g = s + int(gaps[best])
        if g == length:
            q, room = made, room + length - s
            made += 1
        else:
            q, room = open_[g].pop(), room - s
            count[g] -= 1
        left -= s
        where[i], place[i] = q, length - g
        if g > s:
            open_[g - s].append(q)
            count[g - s] += 1
    return where, place


def _place(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        if rows := list(batches):
            t = pa.Table.from_batches(rows).combine_chunks()
            q, at = sum_of_squares(t.column("length").to_numpy(), length)
            t = t.append_column("sequence_id", pa.array(q + (group << 40))).append_column("offset", pa.array(at))
            yield from t.to_batches()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, cache: int = LIMIT) -> DataFrame:
    """One row per piece of docs (doc_id, text), with its sequence and its place there."""
    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = stash(docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary or default_vocabulary(), length, cache), kind), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    return pieces.repartition(groups).mapInArrow(_place(length), kind + ", sequence_id bigint, offset bigint")
