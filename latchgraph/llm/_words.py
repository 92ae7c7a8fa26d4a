"""Vectorised word and shingle hashing over Arrow string arrays.

Words are maximal runs of bytes other than the six ASCII white-space bytes
(``[^\\x20\\x09-\\x0D]+``).  All hashes are 64-bit polynomial hashes computed with
wrap-around numpy arithmetic on the UTF-8 buffer of a whole batch, so no Python
object is made per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE[_SPACE] = 0
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_STEP = 1 << 17  # powers held of each base
_SLICE = 1 << 16


@functools.cache
def _held(base: int) -> np.ndarray:
    return _powers(base, _STEP)


def power_at(base: int, index: np.ndarray) -> np.ndarray:
    """base**index modulo 2**64, from a table of bounded size and one of its last power's powers."""
    base &= _MASK
    out = _held(base)[index & (_STEP - 1)]
    if len(index) and (most := int(index.max()) // _STEP):
        out *= _powers(pow(base, _STEP, 1 << 64), most + 1)[index // _STEP]
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _held(base & _MASK)[:n] if n <= _STEP else power_at(base, np.arange(n))


@functools.cache
def _libc():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on between tasks, and its heap with it."""
    if trim := _libc():
        trim(0)


@functools.cache
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Hashes of the words of each row of a string array.

    ``hash``: one uint64 per word; ``first``: row i has words
    ``first[i]:first[i + 1]``; ``begin``/``end``: byte range of each word in ``data``.
    """

    def __init__(self, texts: pa.Array, lower: bool, split=None):
        """``split`` takes the bytes and tells before which of them a word is cut as well."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int64, count=texts.offset + n + 1)[texts.offset :] if n else np.zeros(1, np.int64)
        size = int(off[-1] - off[0])
        self.data = np.frombuffer(data, dtype=np.uint8, count=int(off[-1]))[off[0] :] if size else np.zeros(0, np.uint8)
        off = off - off[0]
        word = ~_SPACE[self.data]
        before = np.zeros(size, dtype=bool)
        before[1:] = word[:-1]
        inner = off[(off > 0) & (off < size)]
        before[inner] = False
        if split is not None:
            before &= ~split(self.data)
        self.begin = np.flatnonzero(word & ~before)
        after = np.zeros(size, dtype=bool)
        after[:-1] = word[1:] & before[1:]
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.begin, off).astype(np.int64)
        self.hash = np.zeros(len(self.begin), dtype=np.uint64)
        table = _LOWER if lower else _TABLE
        # slices of whole words, so that what stands in memory beside the text does not grow with it
        cuts = np.unique(np.append(np.searchsorted(self.begin, np.arange(0, size, _SLICE)), len(self.begin)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            start = int(self.begin[a])
            values = table[self.data[start : int(self.end[b - 1])]]
            # positions count from the slice's start; the inverse power moves each word to its own
            values *= powers(_BYTE_BASE, len(values))
            at = self.begin[a:b] - start
            self.hash[a:b] = mix(np.add.reduceat(values, at) * power_at(inverse(_BYTE_BASE), at))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and each row's first place among them (rows + 1).

        A row of 1 to k - 1 words gives its whole sequence as one shingle.
        """
        counts = self.counts
        full = np.maximum(counts - k + 1, 0)
        short = (counts > 0) & (full == 0)
        number = full + short
        first = np.concatenate(([0], np.cumsum(number)))
        out = np.zeros(first[-1], dtype=np.uint64)
        h = self.hash
        if len(h):
            base = powers(_WORD_BASE, k)
            places = np.repeat(self.first[:-1] - first[:-1], number) + np.arange(first[-1])
            if len(h) >= k:
                run = np.zeros(len(h), dtype=np.uint64)
                m = len(h) - k + 1
                for j in range(k):
                    run[:m] += h[j : j + m] * base[j]
                out = run[places]
            for i in np.flatnonzero(short):
                part = h[self.first[i] : self.first[i + 1]]
                out[first[i]] = np.sum(part * base[: len(part)], dtype=np.uint64) + U(len(part))
        return mix(out), first


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of text each (a longer row stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = 0, len(sizes)
    total = np.concatenate(([0], np.cumsum(sizes)))
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    give_back()
