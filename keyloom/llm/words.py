"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of code points other than U+0020 and U+0009-U+000D.  All of these
separators are single bytes in UTF-8, so words are found on the bytes of the Arrow buffer
without decoding.  A word is represented by a 64-bit hash: its length and its bytes, eight at a time,
chained by avalanche steps; or, if it is long, a polynomial over its bytes.  Hashes depend on the bytes alone, never on
the process, the batch or the position.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text is handled in slices of about this many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 20
#: Hashes are computed over blocks of so many words or bytes, whose temporary arrays fit a core's cache.
BLOCK_WORDS, BLOCK_BYTES = 1 << 13, 1 << 16
#: Longest span, in bytes, that is hashed eight bytes at a time.
SHORT = 64

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: The low 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def separators(raw: np.ndarray) -> np.ndarray:
    """Which bytes are U+0020 or U+0009-U+000D."""
    found = (raw - np.uint8(9)) <= 4
    found |= raw == 32
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step over uint64 (wraps around)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(_BASE, -1, 2**64)


def trim() -> None:
    """Gives freed memory back to the system: idle Python workers otherwise keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, a function for mapInArrow, with memory given back after each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                trim()

        yield from f(each())
        trim()

    return run


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one Arrow string array with 64-bit offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of the n texts: n + 1 numbers from 0)."""
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes; a longer text is a range of its own."""
    _, at = bytes_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of all words; a word never crosses an offset in `at`."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = separators(raw)
    gap = np.flatnonzero(apart)
    edge = np.empty(len(gap) + 2, np.int64)
    edge[0], edge[1:-1], edge[-1] = -1, gap, len(raw)
    starts, ends = edge[:-1] + 1, edge[1:]
    full = ends > starts
    starts, ends = starts[full], ends[full]
    cut = np.unique(at[(at > 0) & (at < len(raw))])
    cut = cut[~apart[cut] & ~apart[cut - 1]]  # within what would be one word
    place = np.searchsorted(starts, cut)
    return np.insert(starts, place, cut), np.insert(ends, place - 1, cut)


def _mixed(x: np.ndarray) -> np.ndarray:
    """mix, in place."""
    x ^= x >> _U(31)
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _polynomials(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, of any length."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK_BYTES, "right")))
        first, last = int(starts[lo]), int(ends[hi - 1])
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTE[raw[first:last]] * powers(_BASE, last - first), out=total[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = mix((total[e] - total[s]) * powers(_INVERSE, last - first)[s] + (e - s).view(np.uint64))
        lo = hi
    return out


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by blocks so that temporary arrays stay small."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each one on
    for lo in range(0, len(starts), BLOCK_WORDS):
        start = starts[lo : lo + BLOCK_WORDS]
        size = ends[lo : lo + BLOCK_WORDS] - start
        x = eight[start]
        x &= _LOW[np.minimum(size, 8)]
        x ^= size.view(np.uint64) * _U(_BASE)
        out[lo : lo + BLOCK_WORDS] = _mixed(x)
    size = ends - starts
    live, done = np.flatnonzero((size > 8) & (size <= SHORT)), 8
    while len(live):
        more = eight[starts[live] + done]
        more &= _LOW[np.minimum(size[live] - done, 8)]
        more += out[live] * _U(_BASE)
        out[live] = _mixed(more)
        done += 8
        live = live[size[live] > done]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        out[long] = _polynomials(raw, starts[long], ends[long])
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets of the n texts into them)."""
    raw, at = bytes_of(column)
    starts, ends = spans(raw, at)
    return hashes(raw, starts, ends), np.searchsorted(starts, at)


def windows(word: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie within one text, and their first words."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero(owner[: len(word) - n + 1] == owner[n - 1 :])
    total = np.zeros(len(ok), np.uint64)
    for k in range(n):
        total = mix(total * _U(_BASE) + word[ok + k])
    return total, ok


def owners(at: np.ndarray) -> np.ndarray:
    """For each element, the text that it belongs to."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
