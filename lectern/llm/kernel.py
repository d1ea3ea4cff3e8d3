"""Vectorised text kernels over Arrow string buffers.

Every function takes whole texts; a batch is worked through in slices of about
``SLICE`` bytes so that the working set of a Python worker stays small no matter
how many rows a batch holds.  A single longer text forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []

#: Bytes that belong to a word: ASCII letters and digits, and all of any character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the xor-shift-multiply steps of SplitMix64); works on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]))
            for b in (_BASE, _INVERSE)
        ]
    return _powers[0], _powers[1]


def as_string(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """One contiguous string array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets within those bytes), covering all rows in order."""
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of some texts: byte bounds, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        self.data, self.rows = data, rows
        inside = WORD[data]
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            cuts = rows[:-1][np.diff(rows) > 0]  # a word never crosses from one text into the next
            before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
            after[cuts[1:] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, rows)
        up, self.down = powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Position-independent hashes of the byte ranges [start, end)."""
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])

    @property
    def hashes(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_hash(word: str) -> int:
    """The hash that ``Words`` gives a word standing alone."""
    data = np.frombuffer(word.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]))
    return int(w.hash(np.array([0]), np.array([len(data)]))[0])


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` items within each row, and where each row's runs begin.

    A row of 1 to k-1 items has one run, all that it has; a row of none has none.
    """
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(runs)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    room = np.repeat(np.minimum(n, k), runs)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = j < room
        term = h[np.where(inside, at + j, 0)]
        out = np.where(inside, mix(out + term), out)
    return out, begin


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list array of ``values`` cut at ``bounds``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def range_hashes(data: np.ndarray):
    """A function of (start, end) that gives position-independent hashes of byte ranges of ``data``."""
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return lambda start, end: mix((prefix[end] - prefix[start]) * down[start])
