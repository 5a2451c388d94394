"""Words, n-grams and their 64-bit hashes of whole Arrow string columns, computed with numpy on the column's own bytes.

A word is a run of bytes other than space and 0x09-0x0D. All hashes are polynomial sums modulo 2^64 over random byte
values, so the hash of any run of bytes or words is a difference of two prefix sums; a final mix spreads the bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone. It bounds memory and changes no result.
CHUNK_BYTES = 1 << 18

_BYTE_STEP, _WORD_STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash spread over the whole word (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


@functools.cache
def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


@functools.cache
def _is_word() -> np.ndarray:
    flags = np.ones(256, dtype=bool)
    flags[[0x20, *range(0x09, 0x0E)]] = False
    return flags


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _steps(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step^j and step^-j modulo 2^64 for j < n."""
    if step not in _powers or len(_powers[step][0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for base in (step, pow(step, -1, 1 << 64)):
            ones = np.full(size, base, dtype=np.uint64)
            ones[0] = 1
            both.append(np.multiply.accumulate(ones))
        if size > 8 * CHUNK_BYTES:
            return both[0], both[1]
        _powers[step] = (both[0], both[1])
    up, down = _powers[step]
    return up[:n], down[:n]


class Words:
    """Words of some consecutive texts: bounds in ``data``, hashes, and the word range of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = (_is_word() if letters is None else letters)[data]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)
        up, down = _steps(_BYTE_STEP, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_byte_values(lower)[data] * up[:n], out=sums[1:])
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def text_of(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every run of n words inside one text."""
        return grams(self.hashes, self.first, n)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of n hashes that stays inside one range of ``first``."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = _steps(_WORD_STEP, total + 1)
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:total], out=sums[1:])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(total) >= n
    at = np.flatnonzero(room)
    return at, mixed((sums[at + n] - sums[at]) * down[at] + np.uint64(n))


def run_hashes(hashes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of the run of n[i] hashes from at[i] on; equal to that of ``grams`` for the same run."""
    up, down = _steps(_WORD_STEP, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=sums[1:])
    return mixed((sums[at + n] - sums[at]) * down[at] + n.astype(np.uint64))


def chunks(texts: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES, letters: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of slices of a string column; nulls are empty texts.

    ``letters`` marks the bytes that words consist of, if they are other than usual.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + chunk, side="right")) - 1)
        yield low, high, Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], lower, letters)
        low = high


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
