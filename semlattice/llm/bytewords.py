"""Words of Arrow string columns as NumPy arrays, without a Python object per word.

Works on the UTF-8 bytes of a slice of the column: a table of 256 entries tells which
bytes belong to words and gives each byte a fixed random 64-bit value (upper-case A-Z
the value of its lower case). A word's hash is the polynomial of its bytes' values modulo
2^64, taken from running sums, so equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Not a separator: everything but space and 0x09-0x0D.
NON_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Digits, letters and all bytes of non-ASCII characters.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads a hash over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


@cache
def _second_values() -> np.ndarray:
    values = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(_BASE))
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                out = np.ones(size, np.uint64)
                filled = 1
                while filled < size:
                    out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
                    filled *= 2
                both.append(out)
        _powers.clear()
        _powers[size] = (both[0], both[1])
    return _powers[size]


@dataclass
class Words:
    """Words of consecutive rows. first[r]:first[r + 1] are the words of row r."""

    rows: slice
    data: np.ndarray  # bytes of the rows
    row_at: np.ndarray  # where each row begins in data, and the end
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Of the words, or of any byte ranges that lie within words."""
        start, end = self.start if start is None else start, self.end if end is None else end
        return mix((self.sums[end] - self.sums[start]) * _power_table(len(self.sums))[1][start])

    def second_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of byte ranges within words' rows, from other byte values than hashes() takes, so that both agree by chance only."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_second_values()[self.data] * _power_table(len(sums))[0][: len(self.data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * _power_table(len(sums))[1][start])


def word_hash(word: str) -> int:
    """The hash that Words.hashes gives this word."""
    return int(next(slices(pa.array([word]), np.ones(256, bool))).hashes()[0])


def slices(column: pa.Array, is_word: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The column in slices of about `limit` bytes (one longer row is a slice of its own). Null: no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield _words(slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], is_word)
        at = to


def _words(rows: slice, data: np.ndarray, row_at: np.ndarray, is_word: np.ndarray) -> Words:
    n = len(data)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = row_at[:-1][row_at[:-1] < n]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = row_at[1:][row_at[1:] > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_values()[data] * _power_table(n + 1)[0][:n], out=sums[1:])
    return Words(rows, data, row_at, start, end, np.searchsorted(start, row_at), sums)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's distinct runs of k words, and where each row's begin.

    A row with fewer than k words, but one at least, has its whole sequence as its only shingle.
    """
    h = words.hashes()
    counts = words.counts
    n_runs = np.where(counts >= k, counts - k + 1, 0)
    factors = [np.uint64((_BASE * (2 * i + 1) ** 5 + 2 * i) & _MASK | 1) for i in range(k)]
    if len(h) >= k:
        runs = np.zeros(len(h) - k + 1, np.uint64)
        for i, f in enumerate(factors):
            runs += h[i : len(h) - k + 1 + i] * f
        runs = mix(runs)
        row = np.repeat(np.arange(len(counts)), counts)
        same = row[: len(runs)] == row[k - 1 :]
        runs, row = runs[same], row[: len(runs)][same]
    else:
        runs, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([mix(np.array([sum(int(x) * int(f) for x, f in zip(h[words.first[r] : words.first[r + 1]], factors, strict=False)) + int(counts[r]) & _MASK], np.uint64))[0] for r in short], np.uint64)
        runs, row = np.concatenate([runs, whole]), np.concatenate([row, short])
    assert n_runs.sum() + len(short) == len(runs)
    order = np.lexsort((runs, row))
    runs, row = runs[order], row[order]
    if len(runs):
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
        runs, row = runs[new], row[new]
    return runs, np.searchsorted(row, np.arange(len(counts) + 1))
