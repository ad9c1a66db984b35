"""Helpers for work on texts inside tasks: small slices of Arrow batches, words, and hashes of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII letters and digits and everything beyond ASCII, on lower-cased UTF-8 bytes (the bytes of a code point beyond ASCII are all 0x80 or more).
ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
ASCII_LOWER = bytes.maketrans(_UPPER, _LOWER)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """First column as an Arrow array, the others as lists, in slices, so that only a slice exists as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), *[part.column(i).to_pylist() for i in range(1, part.num_columns)]


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; a null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


class WordHashes(dict):
    """64-bit hash of a word's bytes, kept for words seen; emptied when it holds `limit` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def in_texts(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Hashes of the texts' words, one text after the other, and where the words of each begin and the last end."""
        words = [t.split() for t in texts]
        at = [0, *accumulate(map(len, words))]
        return np.fromiter((self[w] for own in words for w in own), np.uint64, at[-1]), at
