"""Vectorised work on the UTF-8 bytes of Arrow batches: words, hashes, runs of rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Rows are taken in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20

U = np.uint64
_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the odd base of the rolling hash with its inverse.
BYTE_VALUES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)

#: The separators of words: blank, and code points 9 to 13.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, 9, 10, 11, 12, 13]] = True

#: Byte to byte, with A-Z lower-cased.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows and of the end) for runs of rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(BASE), table(BASE_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for exponents below n and possibly more."""
    return _powers(1 << max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Prefix sums of byte values times powers of the base; one longer than data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, from :func:`sums`."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def spans(apart: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of bytes that are not apart; runs end with their row."""
    if not len(apart):
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(apart)
    before[0], before[1:] = True, apart[:-1]
    after = np.empty_like(apart)
    after[-1], after[:-1] = True, apart[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(apart)]] = True
    after[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(~apart & before)
    return starts, np.flatnonzero(~apart & after) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word data[start:end], A-Z as a-z: its length, then eight bytes at a time, mixed after each.

    Words of up to eight bytes and one length never share a hash. Words of over 256 bytes are hashed by xxhash.
    """
    folded = np.zeros(len(data) + 8, np.uint8)
    np.take(FOLD, data, out=folded[: len(data)])
    eights = np.ndarray((len(data) + 1,), "<u8", folded, strides=(1,))
    length = ends - starts
    out = length.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    at, left = starts, length
    for lo in range(0, 256, 8):
        if lo:
            more = np.flatnonzero(left > lo)
            if not len(more):
                return out
            at, short = starts[more] + lo, left[more] - lo
        else:
            more, short = slice(None), left
        chunk = eights[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(8) * np.maximum(8 - short, 0).astype(np.uint64)))
        out[more] = mix(out[more] ^ chunk) + U(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(length > 256):
        out[i] = xxhash.xxh3_64_intdigest(folded[starts[i] : ends[i]])
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of all words as one if they are fewer; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = h * U(BASE) + words[i : len(words) - k + 1 + i]
    return mix(h + U(k))
