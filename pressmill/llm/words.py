"""Words and word shingles of Arrow string columns as 64-bit hashes, by numpy over the column's bytes.

A word is a maximal run of bytes of one class; case is folded for A-Z alone. The hash of a word is a polynomial over
its bytes, mixed; equal words have equal hashes, and different words collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: All but white space, [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; every non-ASCII byte belongs to a word.
LETTER_DIGIT = np.zeros(256, bool)
LETTER_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of BASE and of its inverse, kept up to the longest chunk seen."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES)
            self.up, self.down = (self._of(base, n) for base in (BASE, BASE_INVERSE))
        return self.up, self.down

    @staticmethod
    def _of(base: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(out, dtype=np.uint64)


_POWERS = _Powers()


@dataclass
class Words:
    """The words of some rows. first[i]:first[i + 1] are those of row i; start and end are byte offsets into data."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def of_bytes(data: np.ndarray, offsets: np.ndarray, word_class: np.ndarray) -> Words:
    """Words of rows data[offsets[i]:offsets[i + 1]]."""
    low = LOWER[data]
    inside = word_class[low]
    n = len(low)
    if not n:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, low)
    begins = np.empty(n, bool)
    begins[0] = True
    np.logical_not(inside[:-1], out=begins[1:])
    cuts = offsets[:-1]
    begins[cuts[cuts < n]] = True
    start = np.flatnonzero(inside & begins)
    ends = np.empty(n, bool)
    ends[-1] = True
    np.logical_not(inside[1:], out=ends[:-1])
    last = offsets[1:] - 1
    ends[last[last >= 0]] = True
    end = np.flatnonzero(inside & ends) + 1
    up, down = _POWERS.upto(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * down[start])
    return Words(hashes, np.searchsorted(start, offsets).astype(np.int64), start, end, low)


def chunks(column: pa.Array, word_class: np.ndarray) -> Iterator[tuple[int, Words]]:
    """Words of a string column, some rows at a time, with the number of the first of those rows. Nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, n)
        lo, hi = int(offsets[row]), int(offsets[stop])
        yield row, of_bytes(data[lo:hi], offsets[row : stop + 1] - lo, word_class)
        row = stop


#: Odd multipliers, one for each place in a shingle.
PLACES = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, those over a row's end included."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * PLACES[0]
        for j in range(1, k):
            out = out + hashes[j : j + n] * PLACES[j]
        return mix(out + np.uint64(k))


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted set of k-word shingles; a row of fewer words is one shingle, one without words none."""
    all_grams = grams(words.hashes, k)
    for i in range(len(words)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= k:
            yield np.unique(all_grams[a : b - k + 1])
        else:
            yield grams(words.hashes[a:b], int(b - a)) if b > a else np.empty(0, np.uint64)
