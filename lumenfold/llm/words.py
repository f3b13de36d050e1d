"""Words, shingles and their hashes over whole Arrow batches of texts, in numpy.

A word is a run of bytes outside space and \\t-\\r, with A-Z lower-cased. Words
are hashed to 64 bits from prefix sums of a random byte table times powers of an
odd base, so every word of a batch is hashed at once.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEP = np.ones(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = False
_IS_WORD = _SEP
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes hashed at a time, and bytes of text in a chunk of a batch.
SLICE, CHUNK = 1 << 18, 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(n, SLICE + 4096)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size <= 4 * SLICE:
            _powers[int(base)] = got
    return got[:n]


def tidy() -> None:
    """Give memory that a task no longer needs back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """The texts of one chunk: bytes, word bounds and the words of each text.

    at[i] : at[i + 1] are the words of text i; starts and ends are byte positions.
    """

    def __init__(self, column: pa.Array) -> None:
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
        n = len(column)
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = whole[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        self.null = np.array(column.is_null()) if column.null_count else np.zeros(n, bool)
        inside = np.zeros(len(self.bytes) + 2, bool)
        inside[1:-1] = _IS_WORD[self.bytes]
        here = inside[1:-1]
        cut = np.zeros(len(self.bytes) + 1, bool)
        cut[self.offsets] = True
        self.starts = np.flatnonzero(here & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
        self.at = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SLICE, "right")))
            lo = self.starts[i]
            part = _TABLE[self.bytes[lo : self.ends[j - 1]]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _power(_BASE, len(part)), out=sums[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * _power(_INVERSE, len(part))[s])
            i = j
        return out


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about size bytes of text each, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    strings = column if pa.types.is_string(column.type) else column.cast(pa.string())
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        if offsets[j] - offsets[i] > 8 * size:
            tidy()  # after a very long text
        i = j


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row (those over the border of two texts as well)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = mix(words[:n] + np.uint64(k))
    for j in range(1, k):
        acc = mix(acc * np.uint64(3) + words[j : j + n])
    return acc


def shingle_sets(texts: Texts, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (63 bits) of its k-word shingles.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    words = texts.hashes()
    all_windows = windows(words, k) >> np.uint64(1)
    for i in range(len(texts)):
        a, b = texts.at[i], texts.at[i + 1]
        if b - a >= k:
            yield np.unique(all_windows[a : b - k + 1])
        elif b > a:
            yield windows(words[a:b], int(b - a)) >> np.uint64(1)
        else:
            yield np.zeros(0, np.uint64)


def to_lists(arrays: list[np.ndarray], kind: pa.DataType, dtype: type = np.int64) -> pa.ListArray:
    """An Arrow list column of numpy arrays."""
    sizes = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=sizes[1:])
    flat = np.concatenate(arrays).astype(dtype) if arrays else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, kind))
