"""Token ids of whole texts, word by word through a bounded cache.

The vocabulary ``word_bpe_49k.json`` drops white space and never joins across it, so a
text's ids are the ids of its pieces between ASCII white space, one after the other.
Pieces recur; their ids are kept until ``LIMIT`` are held, then the cache starts anew.
The cache changes the speed only.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

END = 1
LIMIT = 700_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What the vocabulary's own rules split ASCII and precomposed Latin letters into, once in
#: lower case. Such text has no other normal form, and no part crosses another.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
#: The characters by which a byte-level vocabulary spells bytes: printable ones as they are, then the others from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_SPELL = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class _Cache(dict):
    """Text to its ids as little-endian 32-bit integers."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: bytes | str) -> bytes:
        ids = self.make(key)
        if len(key) <= 64:
            self[key] = ids
        return ids


class Encoder:
    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit = self.tokenizer.model, limit
        self.size = self.tokenizer.get_vocab_size()
        self.pieces, self.parts = _Cache(self._piece), _Cache(self._part)

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(_SPELL)
        return np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of UTF-8 text and the end id."""
        for cache in (self.pieces, self.parts):
            if len(cache) > self.limit:
                cache.clear()
        out = b"".join(map(self.pieces.__getitem__, text.split()))
        return np.frombuffer(out + END.to_bytes(4, "little"), "<u4")


@lru_cache(1)
def encoder(path: str, limit: int = LIMIT) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, limit)


def texts(column: pa.Array):
    """The UTF-8 bytes of each text; null is empty."""
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""
