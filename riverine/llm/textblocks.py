"""Vectorised words and hashes of the texts of an Arrow batch.

All functions work on whole blocks of texts laid end to end, so there is no Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: ASCII white space: space and \x09-\x0D.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
WORD = ~SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Texts laid end to end, 8 spare bytes behind them. offsets: of each text's start, and of the end."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def block(column: pa.Array, lower: bool = False) -> Block:
    """Nulls become empty texts; lower lower-cases A-Z only."""
    if column.null_count:
        column = column.fill_null("")
    _, ends, raw = column.buffers()
    width = "<i8" if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else "<i4"
    offsets = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    text = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    data = np.zeros(len(text) + 8, np.uint8)
    data[: len(text)] = _LOWER[text] if lower else text
    return Block(data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows into slices of about `size` bytes of a text or binary column."""
    sizes = np.zeros(1)
    if batch.num_rows:
        texts = batch.column(column)
        plain = texts.fill_null(b"").cast(pa.large_binary()) if pa.types.is_binary(texts.type) else texts.fill_null("").cast(pa.large_string())
        sizes = np.frombuffer(plain.buffers()[1], "<i8")[: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Hands freed memory back to the system, which a worker that lives on would keep beside the JVM's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@dataclass
class Words:
    """starts and lengths of words in the block's data; first[i] to first[i + 1] are those of text i."""

    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def segments(b: Block, begins: np.ndarray, inside: np.ndarray) -> Words:
    """Runs of bytes that are `inside`, cut before each that `begins`, and at the ends of texts."""
    n = int(b.offsets[-1])
    at = b.offsets[:-1][b.offsets[:-1] < n]
    begins = begins.copy()
    begins[at] = True
    begins &= inside
    begins[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(begins)
    stops = np.zeros(n, bool)  # the last byte of a run
    if n:
        stops[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
        stops[-1] = inside[-1]
    ends = np.flatnonzero(stops) + 1
    return Words(starts, ends - starts, np.searchsorted(starts, b.offsets))


def words(b: Block) -> Words:
    """Maximal runs of bytes that aren't ASCII white space."""
    inside = WORD[b.data[: int(b.offsets[-1])]]
    return segments(b, np.zeros(len(inside), bool), inside)


def hashes(b: Block, w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(b.data) - 7,), "<u8", buffer=b.data, strides=(1,))
    h = mix(w.lengths.astype(np.uint64) * _STEP + np.uint64(seed))
    h = mix(h ^ (eight[w.starts] & _MASK[np.minimum(w.lengths, 8)]))
    rest, done = np.flatnonzero(w.lengths > 8), 8
    while len(rest):
        left = w.lengths[rest] - done
        h[rest] = mix(h[rest] * _STEP ^ (eight[w.starts[rest] + done] & _MASK[np.minimum(left, 8)]))
        rest, done = rest[left > 8], done + 8
    return h


def windows(x: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows at every position, and whether the window lies within one text."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = x[:n].copy()
    for j in range(1, k):
        h *= _STEP
        h += x[j : j + n]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(h), text[:n] == text[k - 1 :]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
