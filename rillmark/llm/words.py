"""Vectorised words of Arrow string columns.

A text column reaches Python as one contiguous UTF-8 buffer.  Words are found,
lower-cased (A-Z only) and hashed on that buffer with numpy, without a Python
object for each word.  A word's hash is a multilinear hash of its bytes, mixed;
two different words share one with a chance of about 2**-57.

Nulls count as empty texts.  A text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_WEIGHTS = np.random.default_rng(20240607).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER = LOWER.astype(np.uint64) + np.uint64(1)
#: Words `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xA24BAED4963EE407)))


@dataclass
class Words:
    """Words of consecutive texts: text i has words first[i]:first[i + 1]."""

    raw: np.ndarray  # bytes of the texts, one after the other
    at: np.ndarray  # text i is raw[at[i]:at[i + 1]]
    start: np.ndarray  # of each word in raw
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> bytes:
        return bytes(LOWER[self.raw[self.start[i] : self.end[i]]])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, at: np.ndarray, is_word: np.ndarray = NON_SPACE, hashed: bool = True) -> Words:
    """The words of the texts; without hashes where these are not wanted."""
    n, inside = len(at) - 1, is_word[raw]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(raw, at, none, none, np.zeros(n + 1, np.int64), np.zeros(0, np.uint64))
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not hashed:
        return Words(raw, at, start, end, np.searchsorted(start, at), np.zeros(0, np.uint64))
    kept, length = _LETTER[raw[inside]], end - start
    head = np.cumsum(length) - length
    place = np.arange(len(kept)) - np.repeat(head, length)
    if length.max() > 4096:
        place &= 4095
    kept *= _WEIGHTS[place]
    value = np.add.reduceat(kept, head)
    return Words(raw, at, start, end, np.searchsorted(start, at), mix(value + length.astype(np.uint64)))


def of_column(column: pa.Array | pa.ChunkedArray, is_word: np.ndarray = NON_SPACE, most: int = CHUNK_BYTES, hashed: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Words of a column, by ranges of rows."""
    raw, at = buffers(column)
    for i, j in chunks(at, most):
        yield i, j, words(raw[at[i] : at[j]], at[i : j + 1] - at[i], is_word, hashed)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a text, and the index of each one's first word."""
    if n == 1:
        return w.hash, np.arange(len(w.hash))
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = w.doc()
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    h = w.hash[at]
    for k in range(1, n):
        h = pair(h, w.hash[at + k])
    return h, at


def hash_word(word: bytes) -> np.uint64:
    """The hash that words() gives this one word."""
    raw = np.frombuffer(word, np.uint8)
    return words(raw, np.array([0, len(raw)]), np.ones(256, bool)).hash[0]
