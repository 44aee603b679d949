"""Words of whole Arrow string columns as 64-bit hashes, without a Python loop over words.

A word is a maximal run of word bytes of the UTF-8 text; A-Z count as a-z. Its hash is a
polynomial over its bytes modulo 2**64, taken from one running sum over the whole slice, then
mixed. Rows never join up: a word ends where its row ends. Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 19


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory goes back after the last."""
    yield from batches
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bytes(alnum_only: bool) -> np.ndarray:
    """Which bytes belong to words: 0-9, a-z, A-Z and every byte over 0x7F, or all but ASCII white space."""
    is_word = np.ones(256, bool)
    if alnum_only:
        is_word[:128] = False
        for lo, hi in ((48, 58), (65, 91), (97, 123)):
            is_word[lo:hi] = True
    else:
        is_word[[32, *range(9, 14)]] = False
    return is_word


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows in them) for runs of rows of about ``most`` bytes; one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=column.offset + n + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class WordScanner:
    """Hashes of the words of a column, slice by slice."""

    def __init__(self, is_word: np.ndarray, fold: bool = True):
        """fold: A-Z count as a-z."""
        self.is_word = is_word
        codes = np.arange(256, dtype=np.uint64)
        if fold:
            codes[65:91] += np.uint64(32)
        self.codes = codes + np.uint64(1)
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, SLICE_BYTES + SLICE_BYTES // 4)
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table))

    def spans(self, data: np.ndarray, offsets: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last, and hash of every word; ``also``: bytes at which a word begins inside a run."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self._grow(n + 1)
        w = self.is_word[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        if also is not None:
            cut[:n] |= also
        begins, ends = w.copy(), w.copy()
        begins[1:] &= ~w[:-1] | cut[1:n]
        ends[:-1] &= ~w[1:] | cut[1:n]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
        total = self.codes[data]
        total *= self.powers[:n]
        np.cumsum(total, out=total)
        before = total[begins - 1]
        if len(begins) and begins[0] == 0:
            before[0] = 0
        return begins, ends + 1, mix((total[ends] - before) * self.inverses[begins])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each row's words begin among them."""
        begins, _, hashes = self.spans(data, offsets)
        return hashes, np.searchsorted(begins, offsets).astype(np.int64)

    def scan(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for first, data, offsets in slices(column):
            yield (first, *self.words(data, offsets))


def grams(words: np.ndarray, splits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a row, and where each row's runs begin among them."""
    counts = np.diff(splits)
    sizes = np.maximum(counts - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if len(words) < n or not out[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(splits), np.int64)
    m = len(words) - n + 1
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    inside = np.arange(m) + n <= np.repeat(splits[1:], counts)[:m]
    return mix(total[inside]), out
