"""Words of Arrow text columns as numpy arrays: where they are and a 64-bit code for each.

Two word rules are in use; both lower A-Z only and treat every byte from 0x80 as a letter, so that
whole UTF-8 characters stay together:

- ``SPACED``: words are what stands between ASCII white space (0x20, 0x09-0x0D);
- ``ALNUM``: words are runs of 0-9, A-Z, a-z and non-ASCII characters.

Codes are polynomial hashes over random byte values, mixed; equal words have equal codes. Text is
hashed in pieces of bounded length, whatever the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits (one to one)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, U64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``size`` bytes of text each (one row at least)."""
    offsets = text_buffer(batch[text])[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
    """Starts and ends of all words, and for each row the index of its first word (n + 1)."""
    inside = letters[data]
    follows = np.zeros(len(data), bool)  # a letter of the same row stands before
    follows[1:] = inside[:-1]
    follows[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~follows)
    last = inside.copy()  # no letter of the same row stands behind
    last[:-1] &= ~(inside[1:] & follows[1:])
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    codes = np.empty(len(starts), U64)
    short = _powers(min(PIECE, len(data)) + 1)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        n = int(ends[j - 1] - lo)
        powers, inverse = short if n <= PIECE else _powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_VALUE[data[lo : lo + n]] * powers[:n], out=total[1:])
        a = starts[i:j] - lo
        codes[i:j] = (total[ends[i:j] - lo] - total[a]) * inverse[a]
        i = j
    return mix(codes)


def words(column: pa.Array, letters: np.ndarray):
    """Codes of all words of a text column, and for each row the index of its first word."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_bounds(data, offsets, letters)
    return word_codes(data, starts, ends), first
