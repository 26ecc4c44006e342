"""Words, lines and n-gram hashes of whole Arrow columns, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; all of them are
ASCII, so runs of UTF-8 bytes and runs of characters agree. Hashes are 64-bit
polynomials over randomised byte values, mixed once more at the end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from tablesync.llm import ships

ships(__name__)

#: Text handled at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; tables for usual blocks are kept."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if len(table) <= 2 * BLOCK_BYTES:
            _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Block:
    """Some documents: their UTF-8 bytes end to end, and where each one starts."""

    data: np.ndarray
    offsets: np.ndarray
    rows: slice

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    @cached_property
    def _edges(self) -> np.ndarray:
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        return edge

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal true runs, cut where documents meet."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | self._edges[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        return starts, np.flatnonzero(inside & (~after | self._edges[1:])) + 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~self.space)

    @cached_property
    def first(self) -> np.ndarray:
        """Index of each document's first word; one more entry at the end."""
        return np.searchsorted(self.words[0], self.offsets)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    @cached_property
    def _prefix(self) -> np.ndarray:
        total = np.empty(len(self.data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * _power_table(_BASE, len(self.data)), out=total[1:])
        return total

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        span = self._prefix[ends] - self._prefix[starts]
        return mix(span * _power_table(_BASE_INVERSE, len(self.data) + 1)[starts])

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.hashes(*self.words)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; only where they fit (see :meth:`full`)."""
        return grams(self.word_hashes, k)

    def full(self, k: int) -> np.ndarray:
        """True at the words with at least ``k`` words from there to their document's end."""
        last = self.first[1:][self.doc_of_word]
        return np.arange(len(last)) + k <= last

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Number of true bytes in each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of ``k`` neighbours by doubling; as long as ``values``, the tail is not meaningful."""
    out, width, done, total = values, 1, 0, np.zeros(len(values), np.uint64)
    while k:
        if k & 1:
            total = total * np.uint64(pow(int(_GRAM), width, 1 << 64)) + _shift(out, done)
            done += width
        out = out * np.uint64(pow(int(_GRAM), width, 1 << 64)) + _shift(out, width)
        width *= 2
        k >>= 1
    return mix(total)


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    if not by:
        return x
    out = np.zeros(len(x), np.uint64)
    if by < len(x):
        out[:-by] = x[by:]
    return out


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few rows are Python objects at one time."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def forget_words() -> None:
    """What tokenizers keep in this worker goes: the worker has turned to other work, and they may not be back."""
    if state := sys.modules.get("_llm_worker_state"):
        state.__dict__.clear()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in blocks of about ``limit`` bytes; NULL is an empty text. A worker at blocks keeps no words."""
    forget_words()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], slice(at, end))
        at = end
