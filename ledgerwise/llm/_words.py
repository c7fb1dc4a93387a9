"""Words of whole Arrow text columns as numpy arrays.

A column's UTF-8 bytes are cut into words, and each word becomes a 64-bit hash,
without a Python object per word. Memory is bounded by slicing batches to about
``SLICE`` bytes of text; a single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 1 where a byte of lower-cased UTF-8 belongs to a word.
ALNUM = bytes(int(48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256))
SPACED = bytes(int(b != 32 and not 9 <= b <= 13) for b in range(256))

_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some texts. Word w of all is bytes start[w]:end[w] of data; text i has words first[i]:first[i + 1]."""

    __slots__ = ("data", "start", "end", "first", "_hash")

    def __init__(self, data: bytes, bounds: np.ndarray, kind: bytes):
        self.data = data = data.translate(_LOWER)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = np.frombuffer(data.translate(kind), np.int8)
        edge = np.diff(inside)
        start, end = edge == 1, edge == -1
        cut = bounds[1:-1]  # a word ends where its text ends
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        start[cut] = True
        end[cut] = True
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end)
        self.first = np.searchsorted(self.start, bounds)
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        if self._hash is None:
            size = self.end - self.start
            raw = np.frombuffer(self.data + bytes(8), np.uint8)
            at = np.ndarray((len(self.data) + 1,), "<u8", raw, 0, (1,))
            h = mix((at[self.start] & _KEEP[np.minimum(size, 8)]) + size.astype(np.uint64) * _G)
            more, done = np.flatnonzero(size > 8), 8
            while len(more):
                block = at[self.start[more] + done] & _KEEP[np.minimum(size[more] - done, 8)]
                h[more] = mix((h[more] ^ block) + _G)
                done += 8
                more = more[size[more] > done]
            self._hash = h
        return self._hash

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of at least n bytes, n at most 8, and a hash of their first n bytes."""
        word = np.flatnonzero(self.end - self.start >= n)
        at = np.ndarray((len(self.data) + 1,), "<u8", np.frombuffer(self.data + bytes(8), np.uint8), 0, (1,))
        return word, mix((at[self.start[word]] & _KEEP[n]) ^ (_B >> np.uint64(n)))

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first word, and hash, of each run of k words inside one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], np.diff(self.first))
        p = np.flatnonzero(np.arange(n) + k <= last[:n])
        h = np.full(len(p), k, np.uint64)
        for j in range(k):
            h = mix((h * _G) ^ self.hash[p + j])
        return p, h

    def string(self, a: int, b: int) -> str:
        """Words a:b joined by spaces."""
        return b" ".join(self.data[s:e] for s, e in zip(self.start[a:b], self.end[a:b])).decode()


def sequence_hash(h: np.ndarray) -> np.uint64:
    """The hash of one whole run of words, equal to what ``shingles(len(h))`` gives."""
    out = np.full(1, len(h), np.uint64)
    for x in h:
        out = mix((out * _G) ^ x)
    return out[0]


def portions(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about `size` bytes in a text column, so that what is made of them is bounded."""
    text = batch.column(column).cast(pa.large_string())
    if not len(text):
        return
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def pieces(text: pa.Array, kind: bytes) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) of a column of texts; null is the empty text."""
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    raw = text.buffers()[2] if len(text) else None
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        data = bytes(memoryview(raw)[at[i] : at[j]]) if raw is not None else b""
        yield i, j, Words(data, at[i : j + 1] - at[i], kind)
        i = j
