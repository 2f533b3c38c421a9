"""Vectorised words, shingles and window hashes over a batch of whole texts (numpy, used inside Spark tasks).

A batch is cut into chunks of about CHUNK bytes at text borders, so memory follows the chunk (or one longest text), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base = base
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = n + n // 4
            steps = np.full(m, self.base)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = self.inverse
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_ODD), _Powers(np.uint64(0xD6E8FEB86659FD93))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers = _WORDS) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span, by prefix sums of a polynomial."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


@dataclass
class Words:
    """The words of some texts. rows: each text's place in the batch; first: its first word, of n + 1 entries."""

    rows: np.ndarray
    data: np.ndarray  # the chunk's bytes
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool) -> np.ndarray:
        return span_hashes((_LOWER[self.data] if lower else self.data) + np.uint64(1), self.starts, self.ends, _BYTES)

    def codes(self) -> np.ndarray:
        """One number for each different word."""
        ink = self.data[~_SPACE[self.data]]
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ink)])
        return words.dictionary_encode().indices.to_numpy()

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each run of k words inside one text, and that text's index."""
        n = np.maximum(self.counts - k + 1, 0)
        of = np.repeat(np.arange(len(n)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[of], of

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1 joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True))


def window_hashes(hashes: np.ndarray, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    return span_hashes(hashes, at, at + k)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Words]:
    """The words of a string column (null: no words), chunk by chunk."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.arange(a, b))
        a = b


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch at rows into pieces in which a string column has about `size` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(lengths), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def _words(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(rows, data, none, none, np.zeros(len(rows) + 1, np.int64))
    ink = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    opens = ink.copy()
    opens[1:] &= ~ink[:-1] | border[1:-1]
    closes = ink.copy()
    closes[:-1] &= ~ink[1:] | border[1:-1]
    starts = np.flatnonzero(opens)
    return Words(rows, data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets))
